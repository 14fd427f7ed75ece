import random

import numpy as np

from corpus import frame, sentence
from panelcast.llm.decontaminate import TOKEN, Rules, Windows, _known, contaminated, template

ITEMS = "item_id long, text string"


def run(spark, docs, items, rules=Rules()):
    made = contaminated(frame(spark, docs), frame(spark, items, ITEMS), rules).collect()
    return {(r.doc_id, r.item_id): r for r in made}


def test_templates():
    words = template("Anna has 3 apples and 2.5 kg of $ pears. Bob gave Anna seven dollars.")
    assert words == ["<name>", "has", "<num>", "apples", "and", "<num>", "<unit>", "of", "pears", "bob", "gave", "<name>", "<num>", "<unit>"]
    assert template(None) == template("") == template(" ... ") == []
    assert template("SHE paid 5 % or 7$, Of 12,000.50 (zero)") == ["she", "paid", "<num>", "<unit>", "or", "<num>", "<unit>", "<name>", "<num>", "<num>"]


def test_exact_and_changed_questions(spark):
    question = "Yesterday Anna bought 12 apples and gave 5 apples to Paul, then Anna sold 12 apples for 3 dollars. How many apples does Anna have now?"
    changed = question.replace("Anna", "Maria").replace("Paul", "Kim").replace("12", "40").replace(" 5 ", " 9 ")
    inconsistent = question.replace("12 apples and", "31 apples and").replace("Yesterday Anna", "Yesterday Zoe").replace("then Anna", "then Kurt").replace("does Anna", "does Paul").replace("sold 12", "sold 77")
    rng = random.Random(2)
    docs = [(1, sentence(rng, 50) + ". " + question + " " + sentence(rng, 50)), (2, changed), (3, sentence(rng, 80)), (4, question[:40]), (5, inconsistent), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]
    items = [(70, question), (71, sentence(rng, 20)), (72, "1 2 3 4 5 6 7 8 9 10")]
    made = run(spark, docs, items)
    assert set(made) == {(1, 70), (2, 70)}
    assert made[(2, 70)].consistency == 1.0 and made[(1, 70)].coverage > 0.9
    assert set(run(spark, docs, items, Rules(most_keys=0))) == set(made)


def test_a_word_put_in_or_left_out(spark):
    rng = random.Random(4)
    words = sentence(rng, 40).split()
    docs = [(1, " ".join([*words[:20], "extra", *words[20:]])), (2, " ".join([*words[:20], *words[21:]])), (3, " ".join(words[20:] + words[:20]))]
    made = run(spark, docs, [(9, " ".join(words))], Rules(coverage=0.7))
    assert set(made) == {(1, 9), (2, 9)} and made[(1, 9)].windows == 26


def test_an_exact_copy_is_found_whatever_surrounds_it(spark):
    rng = random.Random(5)
    item = "The farmer carried corn to market on foot. How many sacks could the old mule carry home. Barley was sold beside the church every week."
    title = "Why The Barley Crop Failed And How The Farmer Lived"
    docs = [(1, sentence(rng, 40) + ". As Told: " + title + "\n" + sentence(rng, 30) + ". " + item + " " + sentence(rng, 30)), (2, title)]
    made = run(spark, docs, [(7, item)])
    assert set(made) == {(1, 7)} and made[(1, 7)].coverage == 1.0
    assert set(run(spark, docs, [(7, item)], Rules(most_keys=0))) == {(1, 7)}


def test_short_items_within_longer_texts(spark):
    rng = random.Random(6)
    docs = [(1, sentence(rng, 40) + ". Who painted the night watch? " + sentence(rng, 40)), (2, "who painted the"), (3, sentence(rng, 60) + " two words")]
    items = [(1, "Who painted the night watch?"), (2, "two words"), (3, "Who painted the")]
    assert set(run(spark, docs, items)) == {(1, 1), (2, 3)}


def test_edges(spark):
    rng = random.Random(3)
    item = sentence(rng, 30)
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, sentence(rng, 60_000) + " " + item), (5, "alpha beta gamma delta epsilon")]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon"), (None, item)]
    assert set(run(spark, docs, items)) == {(3, 1), (4, 1), (5, 4)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def slow_windows(text, size, rules):
    """(key, first word, slot values) of the windows of one size in their plain reading, a word at a time."""
    _, _, kind, values, _, _ = Windows(rules).templates.readings(text)
    out = []
    for i in range(len(kind) - size + 1):
        own = range(i, i + size)
        if sum(kind[j] == 0 for j in own) >= min(rules.literals, size):
            key = size
            for j in own:
                key = (key * 0x9E3779B97F4A7C15 + int(kind[j] or values[j])) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                key = (key ^ key >> shift) * factor % 2**64
            key ^= key >> 31
            out.append((key - 2**64 * (key >> 63), i, size, [int(v) for v in values[own.start : own.stop][kind[own.start : own.stop] > 0].view(np.int64)]))
    return out


def test_windows_of_texts_read_together():
    rng = random.Random(8)
    words = "The the Two two 5 3.2 km KM $ % . ! John JOHN j ² Second cat ran and".split()
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 9, 60]))) for _ in range(80)] + [None, "", " ".join(rng.choices(words, k=5_000))]
    rules = Rules(window=8, literals=3)
    together = [[] for _ in texts]
    for t, *window in Windows(rules).of_texts(texts):
        together[t].append(tuple(window))
    for text, own in zip(texts, together, strict=True):
        n = len(template(text))
        assert sorted(own) == sorted(slow_windows(text, min(8, n), rules) if n else [])
    sizes = frozenset((2, 5))
    read = [[] for _ in texts]
    for t, *window in Windows(rules, sizes=sizes).of_texts(texts):
        read[t].append(tuple(window))
    assert [sorted(r) for r in read] == [sorted(Windows(rules, sizes=sizes).of(t)) for t in texts] and sum(map(len, read)) > 1_000


def test_flags_of_tokens():
    flags = {t: _known(t) & 63 for t in TOKEN.findall("One km $ . Km KM John j 3,5 cat")}
    assert flags == {"One": 2, "km": 4, "$": 12, ".": 1, "Km": 20, "KM": 4, "John": 16, "j": 0, "3,5": 2, "cat": 0}
