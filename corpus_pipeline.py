"""A corpus pipeline of five stages, from documents to packed token sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, language, line_windows, ngram_join, packing
from panelcast.llm.common import if_few, small_batches, table, written
from panelcast.llm.queries import SEQUENCE, VOCABULARY


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; others, empty and null texts go."""
    small_batches(spark)
    named = docs.select(F.struct("*").alias("row"), F.col("text"))
    found = language.identify(named, language.fit(docs))
    return found.where(~F.col("_language.rejected")).select("row.*")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later copies of three-line windows, ``n_chars`` of the new text; one of which nothing is left goes."""
    small_batches(spark)
    named = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    kept = line_windows.dedup_lines(named)
    cut = F.col("_lines.n_removed") > 0
    alive = kept.where(~cut | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return alive.select(row.alias("row")).select("row.*")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids in ``gone``; a null id stays."""
    return docs.join(if_few(written(gone, "pipeline-gone")), "doc_id", "left_anti").select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; one without an id stays."""
    small_batches(spark)
    groups = ngram_join.jaccard_join(docs).per_document()
    gone = groups.where("id <> group_id").select(F.col("id").alias("doc_id")).distinct()
    return _without(docs, gone)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; one without an id stays."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    small_batches(spark)
    return packing.pack_with_vocabulary(docs, public_tokenizers.path(VOCABULARY), SEQUENCE)


STAGES = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("packing", packed),
]

#: SQL can't express the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
