"""Named queries of the corpus operators, with SQL where SQL can follow."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import alignment, cap_filters, decontaminate, html_text, language, licenses, line_windows, ngram_join, packing, passages, periodic_runs, secrets, token_counts
from panelcast.llm.common import table
from panelcast.plans.catalogue import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 512
SEQUENCE = 1024


def query(name: str, check: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if check:
            CHECKS[name] = check
        return build

    return register


JACCARD_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM texts),
named AS (SELECT doc_id, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), '|')) END AS digest FROM runs),
classes AS (SELECT digest, min(doc_id) AS class_id, count(*) AS copies, any_value(s) AS s, any_value(len(s)) AS n FROM named WHERE digest IS NOT NULL GROUP BY digest),
grams AS (SELECT class_id, copies, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.class_id AS a, b.class_id AS b, any_value(b.copies) AS copies FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
links AS (SELECT a, sum(copies) AS links FROM pairs GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, (coalesce(c.copies - 1, 0) + coalesce(l.links, 0))::BIGINT AS n_links,
  coalesce(least(c.class_id, m.b), c.class_id, d.doc_id) AS group_id
FROM named d LEFT JOIN classes c USING (digest) LEFT JOIN links l ON l.a = c.class_id LEFT JOIN least m ON m.a = c.class_id"""


@query("op1_ngram_jaccard_join", JACCARD_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class, links and group of every document; five words, similarity 0.8."""
    joined = ngram_join.jaccard_join(table(spark, folder, "documents"))
    return joined.per_document().withColumnRenamed("id", "doc_id")


@query("op2_licence_scan", licenses.licences_sql())
def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document; lists are joined by commas."""
    found = licenses.scan_licences(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_matches", F.array_join("partial", ",").alias("partial"))


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, folder, "documents")
    hidden = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~hidden))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", hidden.alias("held_out"), "_language.*")


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of 50 words or more of every document; spans are written as start-end."""
    found = passages.repeated_by_document(table(spark, folder, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), " ")
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_passages", "n_words", spans.alias("spans"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(vec_id, l.b), vec_id) AS component_id,
  vec_id = coalesce(least(vec_id, l.b), vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id"""


@query("op6_embedding_near_dedup", VECTORS_SQL)
def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and choice of every vector; cosine 0.98 within a label."""
    found = cap_filters.near_vectors(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("group_id").alias("component_id"), F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
filled AS (SELECT doc_id, i, md5(trim(line, ' ' || chr(9) || chr(13))) AS h FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, i AS lo, lead(i, 2) OVER w AS hi,
    h || lead(h) OVER w || lead(h, 2) OVER w AS run
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, lo, hi FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS n FROM windows WHERE hi IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later x ON l.doc_id = x.doc_id AND l.i BETWEEN x.lo AND x.hi),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text AS text
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query("op8_line_dedup", LINES_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_windows.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_with_vocabulary(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), SEQUENCE)


def repeated_block(doc_id: str, text: str) -> Column:
    """``text``, in a tenth of the documents with its words from a place on replaced by repeats of the first few of them.

    With h the checksum of the id and g = h // 10, documents with h % 10 = 0 keep n words but repeat, from word g % n
    on, a block of 1 + (rest // (3 + g % 8)) words. A null id plants nothing.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.slice(w, a + 1, p)
        rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), rest), " ")

    planted = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeated), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(planted, F.lit(""))).otherwise(F.col(text))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of 24 words or more and three periods or more in every document, planted ones included, as digests and the one repeated most."""
    docs = table(spark, folder, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", repeated_block("doc_id", "text").alias("text")))
    first = F.get("runs", F.lit(0))
    best = F.aggregate("runs", first, lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


class GroupDigests:
    """sha256 of the groups of each text, written as ``a1,a2|b1;a3|b2,b3``; '' without groups."""

    def __init__(self):
        self.words = np.empty(0, object)

    def __call__(self, g: alignment.Groups) -> list[str]:
        most = int(max(g.a.max(initial=0), g.b.max(initial=0))) + 1
        if 4 * most > len(self.words):
            self.words = np.array([f"{i}{mark}" for i in range(most) for mark in ",|,;"], object)
        na, nb = np.diff(g.a_of), np.diff(g.b_of)
        of_a, of_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        signs = np.empty(len(g.a) + len(g.b), np.int64)
        signs[np.arange(len(g.a)) + g.b_of[of_a]] = 4 * g.a
        signs[np.arange(len(g.b)) + g.a_of[of_b + 1]] = 4 * g.b + 2
        ends = g.a_of + g.b_of
        signs[ends[:-1] + na - 1] += 1
        signs[ends[1:] - 1] += 1
        words, of = self.words[signs].tolist(), ends[g.of_text].tolist()
        return [hashlib.sha256("".join(words[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(of, of[1:], strict=False)]


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of every document under a byte-level and a sentencepiece vocabulary, with corpus-wide counts of its links."""
    docs = table(spark, folder, "documents")
    aligned = alignment.align(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECE_MODEL), measures={"groups_sha256": GroupDigests()})
    return aligned.per_document("doc_id", "text")


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base patterns, and all spans, those of literals with sensitive names included."""
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def spans(column: str | Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")

    base = F.filter("found", lambda s: s.kind != "literal")
    return found.select(
        "doc_id", counted("assign").alias("n_assign"), counted("access").alias("n_access"), counted("hex").alias("n_hex"),
        F.sha2(spans(base), 256).alias("base_sha256"), spans("found").alias("spans"), counted("literal").alias("n_literal"),
    )
