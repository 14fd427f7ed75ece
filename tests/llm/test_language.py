import random

import numpy as np
from pyspark.sql import functions as F

from corpus import frame
from panelcast.llm.language import Settings, counts, fit, held_out, identify, limits, sampled

TEXTS = {
    "en": "the river was wide and the people walked along the bank with their dogs while it rained and the wind was cold",
    "de": "der fluss war breit und die leute gingen mit ihren hunden am ufer entlang während es regnete und der wind kalt war",
    "fr": "la rivière était large et les gens marchaient le long de la rive avec leurs chiens pendant que le vent était froid",
}


def labelled(spark):
    rows = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        rows += [(100 * k + i, " ".join(words[i % 7 :] + words[: i % 5]), lang) for i in range(40)]
    return frame(spark, rows, "doc_id long, text string, lang string")


def test_nearest_centroid_and_rejection(spark):
    model = fit(labelled(spark))
    texts = ["the dogs walked along the wide bank", "die leute gingen mit hunden", "les gens marchaient avec leurs chiens", "Привет как дела сегодня утром", None, "", "123 !!", "the " * 200_000]
    made = identify(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    found = [r["__language"] for r in made]
    assert [f.lang_pred for f in found] == ["en", "de", "fr", found[3].lang_pred, "und", "und", "und", "en"]
    assert [f.rejected for f in found] == [False, False, False, True, True, True, True, False]
    assert all(0 <= f.score <= 1 for f in found) and made[0]["_language"] == "x"


def test_fit_on_nothing(spark):
    empty = frame(spark, [], "doc_id long, text string, lang string")
    model = fit(empty)
    assert identify(frame(spark, [(1, "some text")]), model).collect()[0]["__language"].lang_pred == "und"
    assert identify(frame(spark, []), model).collect() == []
    nulls = frame(spark, [(None, "abc def", "en"), (1, None, "en"), (2, "abc def", None), (3, "abc def", "en"), (3, "abc def", "en")], "doc_id long, text string, lang string")
    assert identify(frame(spark, [(1, "abc def")]), fit(nulls)).collect()[0]["__language"].lang_pred == "en"


def test_counts_do_not_depend_on_the_chunk(monkeypatch):
    text = "Some längere text, with words " * 50
    whole = counts(text, Settings())
    monkeypatch.setattr("panelcast.llm.language._CHUNK", 7)
    assert np.array_equal(whole, counts(text, Settings()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = held_out(F.col("doc_id"))
    made = identify(docs, fit(docs.where(~hidden))).where(hidden).select("lang", "_language.*")
    total, right, gone = made.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.98 * total and gone <= 0.01 * total


SCRIPTS = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "han": range(0x4E00, 0x5A00), "latin noise": range(0x61, 0x7B)}


def test_unlearned_scripts_and_noise_of_any_length_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = random.Random(3)
    texts = [
        " ".join("".join(chr(made.choice(letters)) for _ in range(made.randint(2, 8))) for _ in range(words))
        for letters in SCRIPTS.values() for words in (50, 120, 300, 800, 2000) for _ in range(5)
    ]
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = [rejected for _, _, rejected in model.predict(texts)]
    assert sum(found) >= 0.95 * len(found)


def test_nearest_centroid_equals_a_plain_loop(spark):
    docs = labelled(spark)
    model = fit(docs)
    texts = [r.text for r in docs.collect()][::7] + ["dogs und rivière", "x"]
    for text, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        weights = [np.log1p(int(n)) * float(w) for n, w in zip(counts(text, model.settings), model.idf, strict=True)]
        length = sum(w * w for w in weights) ** 0.5
        cosines = [sum(w * c for w, c in zip(weights, centre, strict=True) if w) / length for centre in model.centroids]
        assert abs(max(cosines) - score) < 1e-9
        assert any(abs(c - score) < 1e-9 and model.languages[o] == lang for c, o in zip(cosines, model.owner, strict=True))


def test_rows_of_one_id_stay_within_the_sample(spark):
    settings = Settings(sample=64)
    rows = [(7, f"some words {i % 90} and {'more ' * (i % 5)}", "en") for i in range(600)] + [(i, "andere worte", "de") for i in range(50)]
    lettered = frame(spark, rows, "id long, text string, lang string", extra="")
    assert fit(lettered.withColumnRenamed("id", "doc_id"), settings).languages == ("de", "en")
    sizes = {"en": 1, "de": 50}
    assert {r.lang: r["count"] for r in sampled(lettered, sizes, settings).groupBy("lang").count().collect()} == {"en": 32, "de": 32}


def test_limits_rise_with_size():
    made = limits(np.array([0.4, 0.9, 0.5]), np.array([3, 5, 7]), Settings(reject=0.5, low=0.0))
    assert np.allclose(made[:3], 0.2 * np.sqrt([0.125, 0.25, 0.5])) and np.allclose(made[3], 0.2) and np.allclose(made[4:], 0.25)
    assert not limits(np.zeros(0), np.zeros(0, int), Settings()).any()
