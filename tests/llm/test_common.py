import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus import groups
from panelcast.llm.buckets import likely_rows, sides
from panelcast.llm.common import WordHashes, components, if_few, shingles


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_are_those_of_the_pattern(text):
    words = re.findall(r"\w+", text.lower())
    made = WordHashes(stretch=7).of(text)
    assert len(made) == len(words)
    assert np.array_equal(made, WordHashes().of(text))
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(words, made.tolist())) and len(set(by.values())) == len(by)


def test_shingles():
    words = WordHashes()
    a, b = shingles("One two, THREE four five six", words, 5), shingles("zero one two three four five", words, 5)
    assert len(a) == 2 and a[0] == b[1] and a[1] != b[0]
    assert len(shingles("one two", words, 5)) == 1 and not len(shingles(None, words, 5)) and not len(shingles(" .. ", words, 5))
    many = [f"{x}{y}{z}" for x in "abcdefghij" for y in "abcdefghij" for z in "abcdefghij"]
    assert len(set(words.of(" ".join(many)).tolist())) == 1000


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 60)]
    want = groups({n for e in edges for n in e}, edges)
    made = components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "test")
    assert {r.node: r.root for r in made.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", "test").collect() == []


def test_broadcast_only_of_few_rows(spark):
    df = spark.range(10)
    assert "broadcast" in if_few(df, 10)._jdf.queryExecution().logical().toString() and if_few(df, 9) is df


@pytest.mark.parametrize("count", [5, 7, 20])
def test_a_task_between_two_blocks_leaves_pairs_of_one_block_alone(count):
    def rows(block_of, bi, bj):
        return [(9, bi, bj, block_of(i), str(i), 10, 0, np.array([9])) for i in range(count)]

    assert likely_rows(rows(lambda i: 0, 0, 1), 60, 0.8) == [] == likely_rows(rows(lambda i: 1, 0, 1), 60, 0.8)
    assert len(likely_rows(rows(lambda i: 0, 0, 0), 60, 0.8)) == count == len(likely_rows(rows(lambda i: i % 2, 0, 1), 60, 0.8))
    assert sides(np.array([0, 0, 1]), False).tolist() == [[False, False, True], [False, False, True], [False] * 3]
