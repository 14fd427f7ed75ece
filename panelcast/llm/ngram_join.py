"""Jaccard join of documents on word n-grams by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.buckets import LINKS, LINKS_ARROW, arrays, by_task, groups, likely_tasks, pair_rows, per_record, shared_counts, sides, sized, summary, unowned
from panelcast.llm.common import WordHashes, batches, if_few, mix, parts, shingles, signed, written

_SKETCH = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_FULL = 2.0**64


@dataclass(frozen=True)
class Join:
    """Parameters of the join.

    ``width`` words make an n-gram; pairs of ``threshold`` or more are wanted with probability ``recall`` each.
    ``split``: expected tokens that a pair at the threshold shares at each step of a path. ``leaf``: records
    that a bucket may hold to be compared at once; ``leaf_tokens`` bounds the tokens of one side of a block.
    """

    width: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    split: float = 3.0
    leaf: int = 1024
    leaf_tokens: int = 1 << 20

    @property
    def repeats(self) -> int:
        """Runs after which a pair at the threshold shares a leaf with probability ``recall`` at any depth.

        A path survives a step if a shared token is chosen whose subtree survives: the fixed point of
        q = 1 - exp(-split q) bounds every depth from below.
        """
        q = 1.0
        for _ in range(200):
            q = 1 - math.exp(-self.split * q)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - q)))

    @property
    def agree(self) -> int:
        """Sketch bits of 64 that a pair at the threshold shares but for a chance of about 1e-4."""
        p = (1 + self.threshold) / 2
        return math.floor(64 * p - 4.2 * math.sqrt(64 * p * (1 - p)))


def chosen(tokens: np.ndarray, path: np.ndarray, rate: float) -> np.ndarray:
    """Child paths of each path: every token below the rate on that path's own random scale."""
    u = mix(tokens[None, :] ^ mix(path)[:, None])
    picked = u.astype(np.float64) < rate * _FULL
    return mix(u[picked] + np.uint64(0x51))


def sketch(tokens: np.ndarray) -> int:
    """One bit of each of 64 min-hashes."""
    least = np.full(64, np.iinfo(np.uint64).max)
    for i in range(0, len(tokens), 4096):
        np.minimum(least, (tokens[i : i + 4096, None] * _SKETCH[None, :]).min(axis=0), out=least)
    return int(np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view(np.int64)[0])


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def signatures(docs: DataFrame, id_column: str, text_column: str, join: Join) -> DataFrame:
    """(id, digest of the n-gram set, n, sketch, paths of the first step of all runs); no digest for a text without words."""
    rate = join.split / join.threshold
    kind = docs.schema[id_column].dataType.simpleString()
    roots = np.arange(1, join.repeats + 1, dtype=np.uint64)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for frame in parts(frames):
            digest, n, bits, paths = [], [], [], []
            for text in frame.column(1).to_pylist():
                t = np.unique(shingles(text, words, join.width))
                digest.append(_digest(t) if len(t) else None)
                n.append(len(t))
                bits.append(sketch(t) if len(t) else 0)
                paths.append(signed(chosen(t, roots, rate / len(t))) if len(t) else [])
            columns = [frame.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(bits, pa.int64()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "bits", "paths"])

    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, digest binary, n int, bits long, paths array<long>")


def token_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, join: Join) -> DataFrame:
    """(digest, tokens) of the classes in ``wanted`` (digest, id), from their documents; texts stay in place if few are wanted."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    ids = if_few(written(wanted.select(F.col("id").alias("wanted")).distinct(), "join-wanted"))
    texts = source.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for frame in parts(frames):
            sets = [np.unique(shingles(t, words, join.width)) for t in frame.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "tokens"])

    return texts.mapInArrow(run, "digest binary, tokens array<long>")


def _linked(rows: list[tuple], join: Join) -> tuple[list[tuple], np.ndarray]:
    """The task's rows (bucket, bi, bj, block, digest, copies, buckets, tokens) once each, and the pairs that it owns and verifies."""
    rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: (r[3], r[4]))
    pairs = sides(np.array([r[3] for r in rows]), rows[0][1] == rows[0][2]) & ~unowned(rows[0][0], [r[6] for r in rows])
    if pairs.any():
        n = np.array([len(r[7]) for r in rows], np.float64)
        same = shared_counts([r[7] for r in rows]).astype(np.float64)
        pairs &= same >= join.threshold * (n[:, None] + n[None, :] - same) - 1e-9
    return rows, pairs


@dataclass(frozen=True)
class Similar:
    """Result of the join: ``documents`` (id, digest), ``classes`` (digest, class_id, copies) and owned tasks of likely pairs."""

    documents: DataFrame
    classes: DataFrame
    tasks: DataFrame
    join: Join

    def _verified(self, each: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
        join = self.join

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return batches((out for group in groups(frames, 3) for out in each(*_linked(group, join))), arrow)

        return self.tasks.mapInArrow(run, schema)

    def pairs(self) -> DataFrame:
        """(a, b): digests of all pairs of different n-gram sets at or above the threshold, each once."""
        return self._verified(pair_rows, "a binary, b binary", pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    def links(self) -> DataFrame:
        """(digest, peer, links, texts): per task and linked set, a smaller set it reaches and how many documents and sets it links."""
        return self._verified(summary, LINKS, LINKS_ARROW)

    def per_document(self) -> DataFrame:
        """(id, class_id, n_links, group_id) per input row.

        ``class_id``: smallest id with the same n-gram set. ``n_links``: other documents at or above the
        threshold, copies included. ``group_id``: smallest id reachable by links. A text without words is alone.
        """
        return per_record(self.documents, self.classes, self.links(), "join")


def jaccard_join(docs: DataFrame, join: Join = Join(), id_column: str = "doc_id", text_column: str = "text") -> Similar:
    """Pairs of documents whose sets of word n-grams have a Jaccard similarity of ``join.threshold`` or more.

    Words are runs of letters, digits and underscores in lower case; a text with fewer words than an n-gram
    has one n-gram of all of them, and a text without words (or null) links with nothing. Documents with equal
    sets form one class, so copies are compared once. Each run starts a path per chosen token of a set; classes
    that share a path form a bucket. Buckets up to ``leaf`` are compared; larger ones are split on further
    tokens if that at least halves them, else they are compared in pairs of blocks. Pairs must agree in size and in a 64-bit sketch before their sets are fetched and compared exactly. A pair that
    meets in several buckets counts in the one with the smallest number.
    Ids are told apart by value; rows that share id and text count as copies; a null id is larger than any other.
    """
    found = written(signatures(docs, id_column, text_column, join), "join-signatures")
    with_words = found.where("digest is not null")
    classes = with_words.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    steps = with_words.select("digest", "n", "bits", F.explode("paths").alias("bucket")).distinct()
    rows = written(steps.join(sized(steps), "bucket"), "join-buckets")
    done = [rows.where(F.col("size") <= join.leaf)]
    large = rows.where(F.col("size") > join.leaf)
    if large.limit(1).count():
        wanted = large.select("digest").distinct().join(classes, "digest").select("digest", F.col("class_id").alias("id"))
        hot = written(token_sets(docs, wanted, id_column, text_column, join).dropDuplicates(["digest"]), "join-hot-sets")
        while large.limit(1).count():
            children = written(_children(large, hot, join), "join-children")
            sizes = sized(children).join(children.groupBy("bucket").agg(F.min("parent").alias("parent"), F.min("parent_size").alias("parent_size")), "bucket")
            stuck = written(sizes.where(F.col("size") * 2 > F.col("parent_size")).select(F.col("parent").alias("bucket")).distinct(), "join-stuck")
            done.append(large.join(stuck, "bucket", "left_semi"))
            on = sizes.join(stuck.withColumnRenamed("bucket", "parent"), "parent", "left_anti").drop("parent", "parent_size")
            rows = written(children.drop("parent", "parent_size").join(on, "bucket"), "join-buckets")
            done.append(rows.where(F.col("size") <= join.leaf))
            large = rows.where(F.col("size") > join.leaf)
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    likely = likely_tasks(buckets, join.agree, join.threshold, join.leaf, join.leaf_tokens, "join-likely")
    wanted = likely.select("digest").distinct().join(classes, "digest").select("digest", F.col("class_id").alias("id"), "copies")
    sets = token_sets(docs, wanted, id_column, text_column, join).join(wanted.select("digest", "copies"), "digest")
    full = likely.join(sets, "digest").select("bucket", "bi", "bj", "block", "digest", "copies", "buckets", "tokens")
    return Similar(found.select("id", "digest"), classes, by_task(full), join)


def _children(large: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The next step: (bucket, digest, n, bits, parent, its size) of every path that goes on."""
    rate = join.split / join.threshold
    rows = large.select("bucket", "digest", "n", "bits", "size").join(sets, "digest")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("bits", pa.int64()), ("parent", pa.int64()), ("parent_size", pa.int64())])

        def steps() -> Iterator[tuple]:
            for frame in frames:
                columns = [c.to_pylist() for c in frame.columns[:5]]
                for bucket, digest, n, bits, size, tokens in zip(*columns, arrays(frame.column(5)), strict=True):
                    path = np.array([bucket], np.int64).view(np.uint64)
                    for child in signed(chosen(tokens.view(np.uint64), path, rate / n)):
                        yield child, digest, n, bits, bucket, size

        return batches(steps(), arrow)

    out = rows.select("bucket", "digest", "n", "bits", "size", "tokens").mapInArrow(run, "bucket long, digest binary, n int, bits long, parent long, parent_size long")
    return out.dropDuplicates(["bucket", "digest"])
