import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpus import grams, groups, jaccard, sentence, words
from test_line_windows import brute as without_repeated_lines
from test_tokens import check

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, items):
    """The rows after each of the first four stages, by plain loops."""
    after = []
    rows = {i: t for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    after.append(dict(rows))
    cut = {i: (t, n) for i, (t, _, n) in without_repeated_lines(list(rows.items())).items()}
    rows = {i: t for i, (t, n) in cut.items() if not n or t.strip(" \t\r\n")}
    after.append(dict(rows))
    sets = {i: grams(t) for i, t in rows.items()}
    ids = sorted(rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.8]
    root = groups(ids, links)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    after.append(dict(rows))
    found = [" " + " ".join(words(t)) + " " for t in items]
    rows = {i: t for i, t in rows.items() if not any(f in " " + " ".join(words(t)) + " " for f in found)}
    after.append(dict(rows))
    return after


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(12)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    base = [r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    english = [w for t in base for w in t.split() if w.isalpha()]
    text = [" ".join(rng.choice(english) for _ in range(80)) for _ in range(6)]
    lines = "\n".join(" ".join(rng.choice(english) for _ in range(9)) for _ in range(4))
    planted = [
        (9001, text[0]), (9002, text[0]), (9003, text[0] + " more"), (9004, text[1] + "\n" + lines), (9005, lines + "\n" + text[2]),
        (9006, text[3] + " . " + item), (9007, None), (9008, ""), (9009, "12 34 !!"), (9010, lines), (9011, text[4]),
    ]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], COLUMNS)
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)


def test_stages_match_plain_loops(spark, documents):
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in documents.collect()], items)
    docs = pipeline.written(documents, "test-documents")
    for (name, stage), rows in zip(pipeline.STAGES[:-1], want, strict=False):
        made = pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        assert made.dtypes == docs.dtypes
        assert {r.doc_id: r.text for r in made.select("doc_id", "text").collect()} == rows, name
        docs = made
    cut = docs.where("doc_id = 9005").first()
    assert cut is not None and cut.n_chars == len(cut.text) and "\n" not in cut.text
    gone = {9002, 9003, 9006, 9007, 9008, 9009, 9010}
    assert not gone & set(want[-1]) and {9001, 9004, 9005, 9011} <= set(want[-1])
    check(list(want[-1].items()), pipeline.packed(spark, docs, FOLDER).collect())


def test_texts_pass_through_one_python_evaluation(spark):
    rows = [(i, "a b\nc d\ne f\n" + "x" * i, "en", "s", 12) for i in range(4)]
    docs = pipeline.written(spark.createDataFrame(rows, COLUMNS), "test-evaluations")
    made = pipeline.distinct_lines(spark, docs, FOLDER)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in made.collect()} == {0: rows[0][1], 1: "x", 2: "xx", 3: "xxx"}


def test_edges_in_every_stage(spark):
    rows = [(None, sentence(random.Random(1), 30), None, None, None), (1, None, None, "s", 1), (2, "", "en", "s", 0), (3, "the " * 60, "en", "s", 1), (3, "the " * 60, "en", "s", 1), (4, "word", "en", None, 4)]
    docs = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], COLUMNS + ", id long, _language string, row int")
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), FOLDER)
        made = stage(spark, docs, FOLDER)
        assert empty.collect() == [] and made.columns == empty.columns
        if name != "packing":
            assert made.columns == docs.columns
    kept = {name: stage(spark, docs, FOLDER).select("doc_id", F.length("text")).collect() for name, stage in pipeline.STAGES[:-1]}
    assert sorted(str(r.doc_id) for r in kept["lines"]) == ["1", "2", "3", "3", "4", "None"]
    assert sorted(str(r.doc_id) for r in kept["near_duplicates"]) == ["1", "2", "3", "3", "4", "None"]
    assert sorted(str(r.doc_id) for r in kept["decontamination"]) == ["1", "2", "3", "3", "4", "None"]
    assert not {"1", "2"} & {str(r.doc_id) for r in kept["language"]}


def test_run(spark):
    rows = pipeline.run(spark, FOLDER)
    assert rows.count() >= rows.select("doc_id").distinct().count() > 100
