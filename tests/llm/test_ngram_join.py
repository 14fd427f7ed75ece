import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import frame, grams, groups, jaccard, sentence
from panelcast.llm.buckets import shared_counts, sized
from panelcast.llm.ngram_join import Join, jaccard_join, sketch


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows, boiler = [], sentence(rng, 40)
    for i in range(n):
        base = sentence(rng, rng.randint(30, 90))
        rows.append((10 * i, base))
        for k in range(rng.randint(0, 3)):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((10 * i + k + 1, " ".join(words)))
    rows += [(5000 + i, boiler + " " + sentence(rng, 60)) for i in range(40)]
    rows += [(6000 + i, rows[0][1]) for i in range(30)]
    return rows


def expected(rows):
    sets = {i: grams(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if jaccard(sets[a], sets[b]) >= 0.8 - 1e-12]
    count = dict.fromkeys(ids, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = {i: min(j for j in ids if sets[j] == sets[i]) if sets[i] else i for i in ids}
    return {i: (least[i], count[i], g) for i, g in groups(ids, links).items()}


@pytest.mark.parametrize("join", [Join(), Join(leaf=8), Join(leaf=4, leaf_tokens=500)])
def test_links_and_groups_match_all_pairs(spark, join):
    rows = corpus()
    made = jaccard_join(frame(spark, rows), join).per_document().collect()
    assert {r.id: (r.class_id, r.n_links, r.group_id) for r in made} == expected(rows)


def test_pairs_are_those_of_different_sets(spark):
    rows = corpus(5, 25)
    joined = jaccard_join(frame(spark, rows), Join(leaf=8))
    by = {bytes(r.digest): r.class_id for r in joined.classes.collect()}
    made = sorted(tuple(sorted((by[bytes(r.a)], by[bytes(r.b)]))) for r in joined.pairs().collect())
    sets = {i: grams(t) for i, t in rows}
    first = {s: min(i for i, t in sets.items() if t == s) for s in sets.values()}
    want = sorted({tuple(sorted((first[a], first[b]))) for a in first for b in first if a != b and jaccard(a, b) >= 0.8 - 1e-12})
    assert made == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  .. "), (4, "one two"), (5, "One, TWO!"), (None, "one two"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, long), (9, long + " end")]
    made = {(r.id, r.class_id, r.n_links, r.group_id) for r in jaccard_join(frame(spark, rows)).per_document().collect()}
    assert made == {(1, 1, 0, 1), (2, 2, 0, 2), (3, 3, 0, 3), (4, 4, 2, 4), (5, 4, 2, 4), (None, 4, 2, 4), (7, 7, 1, 7), (8, 8, 1, 8), (9, 9, 1, 8)}


def test_empty_table(spark):
    assert jaccard_join(frame(spark, [])).per_document().collect() == []


def test_recall_bound_and_sketch():
    assert Join().repeats == 3 and 0 < Join(split=1.5).repeats <= 20
    rng = np.random.default_rng(0)
    for _ in range(50):
        common = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)])
        assert 64 - ((sketch(a) ^ sketch(b)) & (2**64 - 1)).bit_count() >= Join().agree


def test_shared_counts_in_steps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80)) for _ in range(9)]
    made = shared_counts(sets, step=16)
    assert all(made[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def test_hashes_of_a_hot_bucket_do_not_overflow(spark):
    """1,400 members with large hashes: even less 8 bits their sum has 65."""
    members = spark.range(40_000).select(F.lit(1).alias("bucket"), F.col("id").cast("string").cast("binary").alias("digest"), F.lit(3).alias("n"))
    members = members.where(F.xxhash64("digest") > 2**62 + 2**61 + 2**60).limit(1400)
    twin = members.select(F.lit(2).alias("bucket"), "digest", "n")
    (one, other), less = sized(members.unionByName(twin)).collect(), sized(twin.limit(1399)).first()
    assert (one["size"], one.tokens) == (1400, 4200) and one[1:] == other[1:] and (less.x, less.y) != (one.x, one.y)
