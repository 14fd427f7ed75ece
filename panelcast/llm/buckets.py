"""Buckets of likely pairs, compared in tasks of bounded size.

Rows of a bucket carry the digest of a class (records that are equal), its size ``n`` and a 64-bit sketch. A
bucket is dealt to pairs of blocks, so a hot one becomes many equal tasks; in a task, first sketches and then
full values are compared as matrices. A pair that meets in several buckets belongs to the one with the smallest
number. Only counts and one reachable partner per record leave a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import batches, components, written


def groups(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``keys`` columns; rows come sorted by them."""
    held: list[tuple] = []
    for frame in frames:
        columns = [c.to_pylist() if not pa.types.is_list(c.type) else arrays(c) for c in frame.columns]
        for row in zip(*columns, strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def column_groups(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first ``keys`` columns, equal neighbours once; rows come sorted by all columns."""
    held: list[np.ndarray] | None = None
    for frame in frames:
        columns = [c.to_numpy(zero_copy_only=False) for c in frame.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        steps = [c[1:] != c[:-1] for c in columns]
        new = np.concatenate([[True], np.logical_or.reduce(steps)])
        columns = [c[new] for c in columns]
        starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1, [len(columns[0])]])
        for i, j in zip(starts[:-2], starts[1:-1], strict=True):
            yield [c[i:j] for c in columns]
        held = [c[starts[-2] :] for c in columns]
    if held is not None:
        yield held


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sides(blocks: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs of rows a task compares: all of its one block (``same``), or those between its two blocks, of which one may be empty."""
    if same:
        return np.triu(np.ones((len(blocks), len(blocks)), bool), 1)
    return (blocks[:, None] < blocks[None, :])


def likely_rows(rows: list[tuple], agree: int, ratio: float) -> list[tuple]:
    """Rows (bucket, bi, bj, block, digest, n, bits, buckets) that have a partner in a pair that this task owns, of similar size and sketch."""
    rows = list({r[4]: r for r in rows}.values())
    if len(rows) <= 6:
        hits = set()
        lower = [{*r[7][r[7] < r[0]].tolist()} for r in rows]
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                b = rows[j]
                if (a[1] == a[2] or a[3] != b[3]) and min(a[5], b[5]) >= ratio * max(a[5], b[5]) and 64 - ((a[6] ^ b[6]) & 0xFFFFFFFFFFFFFFFF).bit_count() >= agree and lower[i].isdisjoint(lower[j]):
                    hits |= {i, j}
        return [rows[i] for i in sorted(hits)]
    rows.sort(key=lambda r: r[3])
    n = np.array([r[5] for r in rows], np.float32)
    bits = np.array([r[6] for r in rows], np.int64).view(np.uint64)
    pairs = sides(np.array([r[3] for r in rows]), rows[0][1] == rows[0][2])
    for i in range(0, len(rows), 256):
        part = pairs[i : i + 256]
        part &= np.bitwise_count(bits[i : i + 256, None] ^ bits[None, :]) <= 64 - agree
        part &= np.minimum(n[i : i + 256, None], n[None, :]) >= ratio * np.maximum(n[i : i + 256, None], n[None, :])
    if pairs.any():
        pairs &= ~unowned(rows[0][0], [r[7] for r in rows])
    return [rows[i] for i in np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))]


def shared_counts(sets: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, from the tokens that at least two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, step):
        i, j = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(sets), min(step, width - a)), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def unowned(bucket: int, buckets: list[np.ndarray]) -> np.ndarray:
    """Pairs of rows that also meet in a bucket with a smaller number, where they are counted."""
    lower = [b[b < bucket] for b in buckets]
    if not any(len(x) for x in lower):
        return np.zeros((len(buckets), len(buckets)), bool)
    return shared_counts(lower) > 0


def summary(rows: list[tuple], pairs: np.ndarray) -> Iterator[tuple]:
    """(digest, peer, links, texts) of each linked row: the smallest row it reaches here, linked documents, linked texts."""
    both = pairs | pairs.T
    has = np.flatnonzero(both.any(axis=0))
    if not len(has):
        return
    both = both[np.ix_(has, has)]
    rank = {d: i for i, d in enumerate(sorted(rows[i][4] for i in has))}
    label = np.array([rank[rows[i][4]] for i in has])
    names = sorted(rank, key=rank.get)
    while True:
        new = np.minimum(label, np.where(both, label[None, :], len(has)).min(axis=1))
        if (new == label).all():
            break
        label = new
    links = both @ np.array([rows[i][5] for i in has], np.int64)
    for i, at in enumerate(has):
        yield rows[at][4], names[label[i]], int(links[i]), int(both[i].sum())


def pair_rows(rows: list[tuple], pairs: np.ndarray) -> Iterator[tuple]:
    for i, j in np.argwhere(pairs):
        yield min(rows[i][4], rows[j][4]), max(rows[i][4], rows[j][4])


def sized(rows: DataFrame) -> DataFrame:
    """Buckets of (bucket, digest, n, ..) with two records or more, and a fingerprint of their members.

    The sum of the upper halves of the hashes fits in 64 bits for any number of members below 2^32; longer terms overflow in hot buckets.
    """
    h = F.xxhash64("digest")
    members = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 32)).alias("y"))
    return members.where("size > 1")


def tasks(rows: DataFrame, leaf: int, weight: int) -> DataFrame:
    """Rows of each bucket dealt to pairs of blocks: a bucket of any size becomes tasks of bounded size."""
    blocks = F.ceil(F.greatest(F.col("size") / leaf, F.col("tokens") / weight)).cast("int")
    own = F.pmod(F.xxhash64("digest", F.lit(7)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "digest", "n", "bits", "buckets")


def by_task(rows: DataFrame) -> DataFrame:
    key = ["bucket", "bi", "bj"]
    return rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key)


LINKS = "digest binary, peer binary, links long, texts long"
LINKS_ARROW = pa.schema([("digest", pa.binary()), ("peer", pa.binary()), ("links", pa.int64()), ("texts", pa.int64())])


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """One bucket of those with the same members, by a fingerprint of the members."""
    first = buckets.groupBy("size", "tokens", "x", "y").agg(F.min("bucket").alias("bucket"))
    return buckets.join(first, ["size", "tokens", "x", "y", "bucket"], "left_semi")


def likely_tasks(buckets: DataFrame, agree: int, ratio: float, leaf: int, weight: int, name: str) -> DataFrame:
    """(bucket, bi, bj, block, digest, buckets): a written table of the rows that have a likely partner in their task.

    Partners agree in ``agree`` of 64 sketch bits, and their ``n`` are within ``ratio`` of each other. ``buckets`` are all
    buckets of the row's class, by which a task knows the pairs that it owns; their number follows the paths
    of a class, not the table.
    """
    schema = "bucket long, bi int, bj int, block int, digest binary, buckets array<long>"
    arrow = pa.schema([("bucket", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("block", pa.int32()), ("digest", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(((*r[:5], r[7]) for group in groups(frames, 3) for r in likely_rows(group, agree, ratio)), arrow)

    kept = distinct_buckets(buckets)
    met = kept.groupBy("digest").agg(F.collect_set("bucket").alias("buckets"))
    return written(by_task(tasks(kept.join(met, "digest"), leaf, weight)).mapInArrow(run, schema), name)


def per_record(records: DataFrame, classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(id, class_id, n_links, group_id) per row of ``records`` (id, digest).

    ``classes`` has (digest, class_id, copies), ``links`` rows as in ``LINKS``. A record without digest is alone.
    """
    links = written(links, f"{name}-links")
    roots = components(links.select("digest", "peer"), "digest", "peer", f"{name}-groups")
    total = links.groupBy("digest").agg(F.sum("links").alias("links"))
    joined = classes.join(total, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    joined = joined.withColumn("root", F.coalesce("root", "digest"))
    least = joined.where("links is not null").groupBy("root").agg(F.min("class_id").alias("group_id"))
    joined = joined.join(least, "root", "left").select(
        "digest", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id")
    )
    return records.join(joined, "digest", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "id").alias("group_id")
    )
