"""Embedding near-dedup by spherical-cap filters on random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.buckets import LINKS, LINKS_ARROW, arrays, by_task, groups, likely_tasks, per_record, sides, sized, summary, unowned
from panelcast.llm.common import batches, mix, signed, written


@dataclass(frozen=True)
class Caps:
    """``threshold``: least cosine of a link. ``margin``: height of the caps in standard deviations of the
    difference that a pair at the threshold has on one filter. ``leaf``: vectors of one side of a block.
    """

    threshold: float = 0.98
    margin: float = 2.5
    leaf: int = 1024
    seed: int = 11

    @property
    def height(self) -> float:
        return self.margin * math.sqrt(2 * (1 - self.threshold))

    @property
    def agree(self) -> int:
        """Sign bits of 64 that a pair at the threshold shares but for a chance of about 1e-5."""
        p = math.acos(self.threshold) / math.pi
        return 64 - math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p)))


class ProductCode:
    """Filters that are concatenations of one codeword per block of a randomly rotated space.

    The codewords of a block are the axes in both directions, so codes have zero mean and equal length, and the
    rotation makes them random.
    """

    def __init__(self, dimension: int, blocks: int, caps: Caps):
        rng = np.random.default_rng([caps.seed, dimension])
        self.rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.signs = rng.normal(size=(dimension, 64))
        self.parts = np.array_split(np.arange(dimension), min(blocks, dimension))
        self.height = caps.height

    def filters(self, unit: np.ndarray) -> list[int]:
        """List decoding: numbers of all filters within the cap height of the best one, found block by block.

        A partial sum is dropped as soon as the best codewords of the remaining blocks can't lift it into the cap.
        """
        turned = self.rotation @ unit
        scores = [np.concatenate([turned[p], -turned[p]]) * math.sqrt(len(p)) for p in self.parts]
        rest = np.cumsum([0.0, *(s.max() for s in scores[::-1])])[::-1]
        floor = rest[0] - self.height
        sums, codes = np.zeros(1), np.zeros(1, np.uint64)
        for score, later in zip(scores, rest[1:], strict=True):
            wide = sums[:, None] + score[None, :]
            i, j = np.nonzero(wide >= floor - later - 1e-12)
            sums = wide[i, j]
            codes = codes[i] * np.uint64(len(score)) + j.astype(np.uint64)
        return codes.tolist()

    def sketch(self, unit: np.ndarray) -> int:
        return int(np.packbits(unit @ self.signs > 0).view(np.int64)[0])


def blocks_for(dimension: int, rows: int) -> int:
    """The fewest blocks that give at least as many filters as there are vectors."""
    for m in range(2, dimension):
        if (2 * (dimension // m)) ** m >= rows:
            return m
    return max(1, dimension)


def usable(column: str, label: str) -> Column:
    """Whether a vector can link: labelled, filled, finite and not zero."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(F.col(column), lambda x: x != 0)


def near_vectors(vectors: DataFrame, caps: Caps = Caps(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, class_id, n_links, group_id) per input row, over pairs with equal labels and a cosine of ``threshold`` or more.

    Equal vectors of one label form a class. Each class goes to all filters in its cap; filters of a label and
    dimension are buckets. Pairs must agree in 64 random signs before their vectors are fetched and the
    cosine is taken in double precision. The number of filters follows the size of the largest label. A vector without label, null,
    empty, zero, or with null or non-finite components links with nothing. Rows that repeat an id are vectors of
    their own; a null id is larger than any other. Other columns are not read.
    """
    ok = F.coalesce(usable(vector_column, label_column), F.lit(False))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v"), ok.alias("ok"))
    kind = vectors.schema[id_column].dataType.simpleString()
    largest = {r.d: r.n for r in rows.where("ok").groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    sizes = {d: blocks_for(d, n) for d, n in largest.items()}

    def named(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {}
        for frame in frames:
            digests, bits, paths = [], [], []
            for label, v, use in zip(frame.column(1).to_pylist(), arrays(frame.column(2)), frame.column(3).to_pylist(), strict=True):
                if not use:
                    digests.append(None), bits.append(0), paths.append([])
                    continue
                d = len(v)
                if d not in codes:
                    codes[d] = ProductCode(d, sizes[d], caps)
                v = np.asarray(v, np.float64) + 0.0
                unit = v / np.abs(v).max()
                unit = unit / np.linalg.norm(unit)
                space = np.uint64(xxhash.xxh64_intdigest(f"{d} {label}".encode()))
                digests.append(xxhash.xxh3_128_digest(label.encode() + b"\0" + v.tobytes()))
                bits.append(codes[d].sketch(unit))
                paths.append(signed(mix(mix(np.array(codes[d].filters(unit), np.uint64)) ^ space)))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(digests, pa.binary()), pa.array(bits, pa.int64()), pa.array(paths, pa.list_(pa.int64())), frame.column(2)], names=["id", "digest", "bits", "paths", "v"])

    found = written(rows.mapInArrow(named, f"id {kind}, digest binary, bits long, paths array<long>, v array<double>"), "caps-vectors")
    linked = found.where("digest is not null")
    classes = linked.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    steps = linked.select("digest", F.lit(1).alias("n"), "bits", F.explode("paths").alias("bucket")).distinct()
    buckets = written(steps.join(sized(steps), "bucket"), "caps-buckets")
    likely = likely_tasks(buckets, caps.agree, 1.0, caps.leaf, 1 << 40, "caps-likely")
    wanted = likely.select("digest").distinct().join(classes.select("digest", "copies"), "digest")
    values = linked.select("digest", "v").join(wanted, "digest").dropDuplicates(["digest"])
    full = by_task(likely.join(values, "digest").select("bucket", "bi", "bj", "block", "digest", "copies", "buckets", "v"))

    def verified(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches((out for group in groups(frames, 3) for out in summary(*linked_vectors(group, caps.threshold))), LINKS_ARROW)

    return per_record(found.select("id", "digest"), classes, full.mapInArrow(verified, LINKS), "caps")


def linked_vectors(rows: list[tuple], threshold: float) -> tuple[list[tuple], np.ndarray]:
    """The task's rows (bucket, bi, bj, block, digest, copies, buckets, vector) once each, and the pairs it owns and verifies."""
    rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: (r[3], r[4]))
    pairs = sides(np.array([r[3] for r in rows]), rows[0][1] == rows[0][2]) & ~unowned(rows[0][0], [r[6] for r in rows])
    if pairs.any():
        x = np.array([np.asarray(r[7], np.float64) for r in rows])
        x /= np.abs(x).max(axis=1, keepdims=True)
        lengths = np.linalg.norm(x, axis=1)
        pairs &= (x @ x.T) / (lengths[:, None] * lengths[None, :]) >= threshold
    return rows, pairs
