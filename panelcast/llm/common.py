"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.shared import written

WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 2048) -> None:
    """Bounds the Arrow batches that tasks send to Python: texts are long, and idle workers keep what they once held."""
    for name, most in (("maxBytesPerBatch", size), ("maxRecordsPerBatch", rows)):
        setting = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(setting).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a few numbers that every executor can hold (some tens of MB).
FEW_ROWS = 1 << 19


def if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has ``most`` rows or fewer; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A function's results by argument, emptied when it holds ``most`` entries."""

    def __init__(self, make, most: int = 1 << 19):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordHashes:
    """64-bit hashes of the words of a text: runs of letters, digits and underscores in lower case, as ``\\w+`` finds them.

    A word's hash is a polynomial in its code points, taken for all words of a stretch of text at once.
    """

    def __init__(self, stretch: int = 1 << 22):
        self.plain = np.array([chr(c).isalnum() or c == ord("_") for c in range(1 << 16)])
        self.stretch = stretch

    def _in_word(self, codes: np.ndarray) -> np.ndarray:
        low = codes < 1 << 16
        out = np.zeros(len(codes), bool)
        out[low] = self.plain[codes[low]]
        if not low.all():
            high, at = np.unique(codes[~low], return_inverse=True)
            out[~low] = np.array([chr(c).isalnum() for c in high.tolist()])[at]
        return out

    def of(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
        parts, start = [], 0
        while start < len(codes):
            end = start + self.stretch
            inside = self._in_word(codes[start:end])
            while end < len(codes) and inside.all():  # a word longer than a stretch
                end += self.stretch
                inside = self._in_word(codes[start:end])
            if end < len(codes):
                inside = inside[: len(inside) - int(np.argmin(inside[::-1]))]
            parts.append(self._hashes(codes[start : start + len(inside)], inside))
            start += len(inside)
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    @staticmethod
    def _hashes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        letters = np.flatnonzero(inside)
        if not len(letters):
            return np.empty(0, np.uint64)
        first = np.concatenate([[True], np.diff(letters) > 1])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(letters)))
        place = np.arange(len(letters)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), _STEP))
        return mix(np.add.reduceat((codes[letters].astype(np.uint64) + np.uint64(1)) * powers[place], starts))


def shingles(text: str | None, words: WordHashes, width: int) -> np.ndarray:
    """64-bit hashes of the word n-grams of ``text`` in order; one for all words if there are fewer than ``width``."""
    return word_grams(words.of(text), width)


def word_grams(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the n-grams of words with hashes ``h``; one for all words if there are fewer than ``width``."""
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _STEP + h[i : len(h) - size + 1 + i]
    return mix(out)


def parts(frames: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``most`` rows, so that few texts exist as Python strings at a time."""
    for frame in frames:
        for start in range(0, frame.num_rows, most):
            yield frame.slice(start, most)
    pa.default_memory_pool().release_unused()  # the worker may stay idle beside others


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` by any path.

    Alternates two rounds until nothing changes: every neighbour above a node is tied to the node's smallest
    neighbour, then every neighbour below it. Rounds are joins and map-side-combined minima, so no node's
    neighbours ever meet in one task; each round is a written table.
    """
    state = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = tally(state)
    while before[0]:
        around = state.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = written(small.where("u != v").distinct(), name)
        now = tally(state)
        if now == before:
            break
        before = now
    roots = state.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
