import math

import numpy as np

from corpus import groups
from panelcast.llm.cap_filters import Caps, ProductCode, blocks_for, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, digest string, v string"


def expected(rows):
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[i] = (label, x / np.linalg.norm(x))
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    count = dict.fromkeys([r[0] for r in rows], 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], g) for i, g in groups(list(count), links).items()}


def run(spark, rows, caps=Caps()):
    df = spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], SCHEMA)
    return {r.id: (r.n_links, r.group_id) for r in near_vectors(df, caps).collect()}


def planted(seed=2, n=80, d=32):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=d)
        rows.append((100 * i, x.tolist(), int(i % 3)))
        for k in range(int(rng.integers(0, 5))):
            noise = rng.normal(size=d) * np.linalg.norm(x) / math.sqrt(d) * rng.choice([0.02, 0.1, 0.16, 0.2, 0.25])
            rows.append((100 * i + k + 1, ((x + noise) * rng.uniform(0.5, 2)).tolist(), int(i % 3) if rng.random() < 0.9 else 9))
    rows += [(90000 + k, rows[0][1], 0) for k in range(20)]
    return rows


def test_links_match_all_pairs(spark):
    rows = planted()
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, Caps(leaf=4)) == expected(rows)


def test_unusable_vectors_stay_alone(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0, 2.0], None), (7, [], 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [1e-30, 2e-30], 0)]
    made = run(spark, rows)
    assert {i: g for i, (_, g) in made.items()} == {**{i: i for i in range(1, 11)}, 9: 8, 11: 8}
    assert [made[i][0] for i in (8, 9, 11)] == [2, 2, 2]


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_recall_at_the_threshold():
    rng, caps = np.random.default_rng(4), Caps()
    code, missed = ProductCode(64, blocks_for(64, 6000), caps), 0
    for _ in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        z = rng.normal(size=64)
        z -= (z @ x) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z)
        missed += {*code.filters(x)}.isdisjoint(code.filters(y))
    assert missed <= 4


def test_list_decoding_is_complete():
    rng, caps = np.random.default_rng(6), Caps()
    code = ProductCode(12, 3, caps)
    for _ in range(20):
        x = rng.normal(size=12)
        x /= np.linalg.norm(x)
        turned = code.rotation @ x
        parts = [np.concatenate([turned[p], -turned[p]]) * 2 for p in code.parts]
        total = (parts[0][:, None, None] + parts[1][None, :, None] + parts[2][None, None, :]).ravel()
        assert sorted(code.filters(x)) == np.flatnonzero(total >= total.max() - caps.height - 1e-12).tolist()
