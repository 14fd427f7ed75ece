"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r"


def line_windows(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, key, first, last, window): every run of ``width`` consecutive lines that are not blank.

    ``first`` and ``last`` are line numbers from 0, ``window`` a 128-bit digest of the trimmed lines, ``key`` a
    digest of the text that tells rows with one id apart.
    """
    lines = F.transform(F.split(F.col(text_column), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    filled = F.transform(F.filter(lines, lambda x: x.line != ""), lambda x: F.struct(x.i.alias("i"), F.md5(x.line).alias("h")))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), filled.alias("f")).where(F.size("f") >= width)
    run = F.transform(
        F.sequence(F.lit(0), F.size("f") - width),
        lambda k: F.struct(
            F.get("f", k).i.alias("first"),
            F.get("f", k + (width - 1)).i.alias("last"),
            F.unhex(F.md5(F.array_join(F.transform(F.slice("f", k + 1, width), lambda x: x.h), ""))).alias("window"),
        ),
    )
    return rows.select("id", "key", F.explode(run).alias("w")).select("id", "key", "w.first", "w.last", "w.window")


def repeated_lines(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, key, lines): line numbers covered by windows that occur earlier, in the order of (id, key, line)."""
    windows = line_windows(docs, width, id_column, text_column)
    place = F.struct("id", "key", "first")
    seen = windows.groupBy("window").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(seen.select("window", "origin"), "window").where(place > F.col("origin"))
    covered = later.select("id", "key", F.explode(F.sequence("first", "last")).alias("line"))
    return covered.groupBy("id", "key").agg(F.collect_set("line").alias("lines"))


def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, lines in parts:
        out = []
        for text, gone in zip(texts, lines, strict=True):
            drop = set() if gone is None else set(gone)
            out.append(text and "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
        yield pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text less all later occurrences of repeated windows, and ``(n_lines, n_removed)``.

    A window is ``width`` consecutive non-blank lines, compared without blanks at their ends. Its first
    occurrence in the order of (id, text digest, line) stays; lines of all later ones go, also blank lines
    between them. Overlapping windows merge. Texts with fewer than ``width`` filled lines have no window and
    stay. A null text stays null with 0 lines. Rows that repeat id and text are one document and are treated
    alike; a null id sorts first. All columns of ``docs`` stay; the two counts come in a struct ``_lines``
    (``__lines`` and so on where that name is taken).
    """
    name = "_lines"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    # not evaluated again in a filter of the caller: that would take a second Python worker per task
    without = F.pandas_udf(_without, "string").asNondeterministic()
    gone = repeated_lines(docs, width, id_column, text_column).select(F.struct("id", "key", "lines").alias("gone"))
    kept = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_column)
    on = F.col("row").getField(id_column).eqNullSafe(F.col("gone.id")) & (F.xxhash64(text) == F.col("gone.key"))
    joined = kept.join(gone, on, "left")
    has = F.col("gone").isNotNull()
    counts = F.struct(
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.when(has, F.size("gone.lines")).otherwise(0).cast("long").alias("n_removed"),
    ).alias(name)
    new = F.when(has, without(F.when(has, text), "gone.lines")).otherwise(text)
    return joined.select(*[(new if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns], counts)
