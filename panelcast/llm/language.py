"""Language identification by nearest centroids of character n-gram vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import mix, parts

UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled documents, over all languages, that the centroids are fitted to.

    ``reject``: a document is rejected if its cosine to the best centroid is below this share of ``low``, the quantile
    of the cosines of that language's fitted documents of its size class (number of distinct n-gram classes, in powers
    of two). Cosines rise with size, so a class has at most the limit of every larger one.
    """

    dimensions: int = 4096
    longest: int = 3
    centroids: int = 3
    sample: int = 2048
    rounds: int = 10
    reject: float = 0.6
    low: float = 0.01


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def counts(text: str, settings: Settings) -> np.ndarray:
    """Counts of hashed character n-grams of the whole text, letters in lower case, all else one space."""
    out = np.zeros(settings.dimensions, np.int64)
    codes = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for start in range(0, len(codes), _CHUNK):
        part = codes[start : start + _CHUNK + settings.longest - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, settings.longest + 1):
            h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            own = h[: max(0, min(len(h), len(codes) - start - n + 1, _CHUNK))]
            out += np.bincount((mix(own) % np.uint64(settings.dimensions)).astype(np.int64), minlength=settings.dimensions)
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one, with damped counts."""
    x = (np.log1p(found) * idf).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def size_classes(found: np.ndarray) -> np.ndarray:
    """The size class of each row of counts: 0 for none, k for 2^(k-1) to 2^k - 1 distinct n-gram classes."""
    return np.frexp((found > 0).sum(axis=1))[1]


def limits(cosines: np.ndarray, sizes: np.ndarray, settings: Settings) -> np.ndarray:
    """Least accepted cosine of every size class.

    Classes above all fitted documents take the largest fitted one's limit. Below the smallest fitted one a limit falls
    with the root of the size, as the cosine of a part of equal components does.
    """
    top = settings.dimensions.bit_length() + 1
    known = sorted(set(sizes.tolist()))
    out = np.full(top, np.quantile(cosines[sizes == known[-1]], settings.low) if known else 0.0)
    for size in reversed(known):
        out[: size + 1] = np.minimum(out[: size + 1], np.quantile(cosines[sizes == size], settings.low))
    if known:
        out[: known[0]] *= np.sqrt(0.5) ** np.arange(known[0], 0, -1)
    return settings.reject * out


@dataclass(frozen=True)
class Model:
    """Centroids of all languages; ``floors`` holds each language's least accepted cosine per size class."""

    settings: Settings
    idf: np.ndarray
    languages: tuple[str, ...]
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine to the nearest centroid, rejected) of each text."""
        step = 128
        for i in range(0, len(texts), step):
            part = texts[i : i + step]
            use = [has_letter(t) for t in part]
            found = np.array([counts(t, self.settings) if u else np.zeros(self.settings.dimensions, np.int64) for t, u in zip(part, use, strict=True)])
            near = vectors(found, self.idf) @ self.centroids.T
            for u, size, row in zip(use, size_classes(found), near, strict=True):
                if not u or not len(row):
                    yield UNKNOWN, 0.0, True
                    continue
                k = int(np.argmax(row))
                score = float(min(1.0, max(0.0, row[k])))
                yield self.languages[self.owner[k]], score, bool(score < self.floors[self.owner[k], size])


def clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; empty clusters are left out."""
    seeds = [x.mean(axis=0)]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin((x @ np.array(seeds).T).max(axis=1)))])
    centres = np.array(seeds)
    for _ in range(rounds):
        own = np.argmax(x @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T, axis=1)
        centres = np.array([x[own == c].mean(axis=0) for c in range(len(centres)) if (own == c).any()])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def document_frequencies(rows: DataFrame, text_column: str, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram class occurs, over all ``rows``; the sums meet as one row per class."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(settings.dimensions, np.int64), 0
        for frame in parts(frames):
            for text in frame.column(0).to_pylist():
                if has_letter(text):
                    total += counts(text, settings) > 0
                    n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *total[used].tolist()], pa.int64())], names=["i", "n"])

    sums = rows.select(text_column).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(settings.dimensions)
    texts = 0
    for r in sums:
        if r.i < 0:
            texts = r.n
        else:
            out[r.i] = r.n
    return out, texts


def sampled(lettered: DataFrame, sizes: dict[str, int], settings: Settings) -> DataFrame:
    """(lang, i, n): the n-gram classes and counts of at most ``max(8, settings.sample / labels)`` rows of each label.

    ``lettered`` holds (id, text, lang), ``sizes`` about how many ids each label has. Rows come by the smallest hash of the id; of
    rows that share an id those with the smallest classes and counts come first, so the bound holds for any ids.
    """
    each = max(8, settings.sample // max(1, len(sizes)))
    # about four times the ids wanted pass the hash limit of their label, so that few rows meet in the window
    bounds = [F.lit(x) for lang, n in sizes.items() for x in (lang, -(2**63) + min(2**64 - 1, 2**64 * 4 * each // max(1, n)))]
    near = lettered.select("id", "lang").where("id is not null")
    if bounds:
        near = near.where(F.xxhash64("id") <= F.element_at(F.create_map(*bounds), F.col("lang"))).distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = near.withColumn("n", order).where(F.col("n") <= each).select("id", "lang")
    if each * len(sizes) <= 1 << 16:
        picked = F.broadcast(picked)
    chosen = lettered.join(picked, ["id", "lang"], "left_semi").select("lang", "text", F.xxhash64("id").alias("h"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [counts(t, settings) for t in frame.column(1).to_pylist()]
            used = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(2), pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())), pa.array([np.minimum(c[u], 2**31 - 1).astype(np.int32) for c, u in zip(found, used, strict=True)], pa.list_(pa.int32()))],
                names=["lang", "h", "i", "n"],
            )

    read = chosen.mapInArrow(run, "lang string, h long, i array<int>, n array<int>")
    return read.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i", "n"))).where(F.col("at") <= each).select("lang", "i", "n")


def fit(rows: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Fits centroids per label.

    Document frequencies cover all labelled rows. The centroids are fitted to at most ``settings.sample`` rows
    (8 a label if that is more), the same number per label, chosen by the smallest hash of the id.
    """
    rows = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).where("lang is not null")
    df, texts = document_frequencies(rows, "text", settings)
    idf = np.log((1 + texts) / (1 + df)) + 1
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.ids for r in lettered.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids")).collect()}
    labels = sorted(sizes)
    sample = sampled(lettered, sizes, settings).toPandas()
    centres, owner, floors = [], [], []
    for at, label in enumerate(labels):
        own = sample[sample.lang == label].sort_values(["i", "n"], key=lambda c: c.map(tuple)) if len(sample) else sample
        dense = np.zeros((len(own), settings.dimensions))
        for row, (i, n) in enumerate(zip(own.i, own.n, strict=True)):
            dense[row, i] = n
        x = vectors(dense, idf)
        made = clusters(x, settings.centroids, settings.rounds) if len(x) else np.zeros((0, settings.dimensions))
        centres.append(made)
        owner += [at] * len(made)
        floors.append(limits((x @ made.T).max(axis=1) if len(made) else np.zeros(0), size_classes(dense), settings))
    together = np.concatenate(centres) if centres else np.zeros((0, settings.dimensions))
    return Model(settings, idf, tuple(labels), together, np.array(owner, np.int64), np.array(floors))


def predictor(model: Model) -> Callable[[Column], Column]:
    """A column function: text to struct(lang_pred, score, rejected)."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            found = (row for i in range(0, len(texts), 512) for row in model.predict(texts.iloc[i : i + 512].tolist()))
            yield pd.DataFrame(list(found), columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, rejected) named ``_language``, underscores added if taken.

    The whole text is read. ``lang_pred`` is the language of the nearest centroid by cosine and ``score`` that
    cosine; a null text or one without a letter gives ``und``, 0 and rejected. ``rejected`` also marks texts
    too far from every centroid. Repeated rows give repeated results; ids are not needed; all columns stay.
    """
    name = "_language"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], predictor(model)(F.col(text_column)).alias(name))


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
