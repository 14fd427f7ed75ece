import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus import frame, sentence
from panelcast.llm.periodic_runs import Positions, find_runs, numbered, runs_of
from panelcast.llm.queries import QUERIES, repeated_block


def brute(ids, min_length, min_repeats):
    """All runs by trying every period at every place."""
    found = {}
    n = len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_repeats * q):
                found.setdefault((i, length), q)  # smaller periods come first
            i = j + 1
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 9), st.integers(2, 4))
def test_runs_equal_trying_every_period(ids, min_length, min_repeats):
    assert runs_of(np.array(ids, np.int64), min_length, min_repeats) == brute(ids, min_length, min_repeats)


@pytest.mark.parametrize("seed", range(40))
def test_planted_runs(seed):
    rng = random.Random(seed)
    ids = []
    while len(ids) < 400:
        block = [rng.randrange(4 + seed) for _ in range(rng.randint(1, 30))]
        ids += (block * rng.randint(1, 6))[: rng.randint(1, 120)]
    assert runs_of(np.array(ids, np.int64)) == brute(ids, 24, 3)


def test_long_texts():
    n = 200_000
    assert runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert runs_of(np.arange(n) % 1000) == [(0, n, 1000)]
    assert runs_of(np.arange(n)) == []
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 400:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs_of(np.array(fibonacci[1])) == brute(fibonacci[1], 24, 3)


def test_ordered_positions():
    rng = random.Random(1)
    made, kept = Positions(500_000), [500_000]
    for x in rng.sample(range(500_000), 6_000):
        before, after = made.insert(x)
        kept.append(x)
        if len(kept) % 500 == 0:
            kept.sort()
            at = kept.index(x)
            assert (before, after) == ((kept[at - 1] if at else -1), (kept[at + 1] if at + 1 < len(kept) else -1))
    assert list(made) == sorted(kept) and made.size == len(kept)


def test_words_are_split_at_ascii_space_only():
    ids, words = numbered("a b  a b\t\x0bc\x1fd  ")
    assert words == ["a b", "c\x1fd", " "] and ids.tolist() == [0, 0, 1, 2]
    assert numbered("x " * 200_000)[0].tolist() == [0] * 200_000


def test_run_table(spark):
    many = "go on " * 20
    rows = [(1, "start " + many + "end"), (2, None), (3, ""), (4, " \t\n"), (None, many), (1, "start " + many + "end"), (5, "one two")]
    made = sorted(find_runs(frame(spark, rows)).collect(), key=str)
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in made]
    assert sorted(got, key=str) == sorted(
        [(1, [(1, 40, 2)], "start go on end")] * 2 + [(i, [], "") for i in (2, 3, 4)] + [(None, [(0, 40, 2)], "go on"), (5, [], "one two")], key=str
    )
    assert find_runs(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("k", "a " * 30)], "id string, body string")
    assert find_runs(named, "id", "body").first().runs[0].period == 1


def expected(doc_id, text):
    """The contract, step by step."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 24, 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(3)
    texts = [sentence(rng, rng.choice([0, 1, 5, 60, 200])) for _ in range(150)]
    texts += [sentence(rng, 4) + (" " + sentence(rng, q)) * 9 + "\n" + sentence(rng, 3) for q in (1, 3, 7, 20)] + [None, "", "  ", "日本 語 x " * 30]
    rows = [*enumerate(texts), (7, "x " * 40), (-12, "y z " * 50), (None, "u " * 50), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = [(r.doc_id, tuple(r[c] for c in names)) for r in made]
    want = [(i, expected(i, t) if i is not None else expected("x", t)) for i, t in rows]  # a null id has no checksum: nothing is planted
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5


def test_repeated_block_of_extreme_ids(spark):
    for i in range(-60, 60):
        assert zlib.crc32(b"x") % 10  # the stand-in for null ids above plants nothing
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(40)], "doc_id long, text string")
    made = {r.doc_id: r.t for r in df.select("doc_id", repeated_block("doc_id", "text").alias("t")).collect()}
    for i, t in made.items():
        h = zlib.crc32(str(i).encode())
        if h % 10:
            assert t == "a b c d e f"
        else:
            a, words = h // 10 % 6, "a b c d e f".split()
            p = 1 + (6 - a) // (3 + h // 10 % 8)
            assert t.split() == [words[k] if k < a else words[a + (k - a) % p] for k in range(6)]
