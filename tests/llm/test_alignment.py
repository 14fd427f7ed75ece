import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpus import frame, sentence
from panelcast.llm import alignment
from panelcast.llm.alignment import Aligner, align, linked_pairs, stretches
from panelcast.llm.queries import QUERIES
from panelcast.llm.token_counts import byte_symbols

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n  \t x", "▁under", "<|endoftext|> and <s> or <unk>", "日本語 😀‍😀 é ﬁ ½", "a" * 3_000, " " * 3_000, "x\u0000y", "é", "　wide", "0 1 22 333 4444 ,,,, !!??", "it's I'LL we'd"]
LIBRARY = Tokenizer.from_file(JSON)
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
AS_BYTES = {c: b for b, c in enumerate(byte_symbols())}


def brute_groups(text):
    """Groups of (ids of A, ids of B), by walking both token lists; [] where bytes differ."""
    if not text:
        return []
    raw = (" " + text).encode()
    made = LIBRARY.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(AS_BYTES[c] for c in t)) for i, t in zip(made.ids, made.tokens, strict=True)]
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return []
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if j >= len(b) or x <= y and i < len(a):
            out[-1][0].append(a[i][0])
            x += len(a[i][1])
            i += 1
        else:
            out[-1][1].append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y and i + j < len(a) + len(b):
            out.append(([], []))
    return out


def expected(rows):
    groups = [brute_groups(t) for _, t in rows]
    links = [[(a, b) for ga, gb in own for a in ga for b in gb] for own in groups]
    counts = Counter(pair for own in links for pair in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), own, pairs in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append(
            (i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs),
             hashlib.sha256(text.encode()).hexdigest() if own else "")
        )
    return out


@pytest.fixture(scope="module")
def aligner():
    return Aligner(JSON, MODEL)


def listed(g):
    return [[(g.a[g.a_of[k] : g.a_of[k + 1]].tolist(), g.b[g.b_of[k] : g.b_of[k + 1]].tolist()) for k in range(s, e)] for s, e in zip(g.of_text, g.of_text[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=4))
def test_groups_equal_walking_both_lists(aligner, texts):
    assert listed(aligner.groups(texts)) == [brute_groups(t) for t in texts]


def test_odd_texts(aligner):
    texts = [t or "" for t in ODD]
    assert listed(aligner.groups(texts)) == [brute_groups(t) for t in texts]
    assert listed(aligner.groups([])) == []


def test_long_texts_are_cut_where_no_token_reaches(aligner, monkeypatch):
    rng = random.Random(1)
    texts = [sentence(rng, 3_000), "日本" * 2_000 + sentence(rng, 500), "a" * 5_000]
    want = listed(aligner.groups(texts))
    monkeypatch.setattr(alignment.stretches, "__defaults__", (100,))
    assert len(stretches(texts[0])) > 100 and "".join(stretches(texts[1])) == texts[1]
    assert listed(aligner.groups(texts)) == want == [brute_groups(t) for t in texts]


def columns(rows):
    def raw(values):
        return np.array(values, "<i4").tobytes()

    made = [(raw([i for g in r for i in g[0]]), raw([i for g in r for i in g[1]]), raw([len(side) for g in r for side in g])) for r in rows]
    return [pa.array(c, pa.binary()) for c in (zip(*made, strict=True) if made else ([], [], []))]


def flat(found):
    return [(int(r), int(p) >> 24, int(p) & 0xFFFFFF, int(n)) for row, pair, links in found for r, p, n in zip(row, pair, links, strict=True)]


@pytest.mark.parametrize("most", [3, 50, 1 << 22])
@pytest.mark.parametrize("longest", [9, 40])
def test_pairs_equal_all_pairs_of_each_group(most, longest):
    rng = random.Random(most)
    rows = [[([rng.randrange(5) for _ in range(rng.choice([1, 1, 2, longest]))], [rng.randrange(4) for _ in range(rng.choice([1, 2, 7]))]) for _ in range(rng.choice([0, 1, 6]))] for _ in range(30)]
    want = Counter((i, a, b) for i, row in enumerate(rows) for ga, gb in row for a in ga for b in gb)
    made = columns(rows)
    assert sorted(flat(linked_pairs(*made, most))) == sorted((*k, n) for k, n in want.items())
    assert sorted(flat(linked_pairs(*[c.slice(7, 20) for c in made], most))) == sorted((i - 7, a, b, n) for (i, a, b), n in want.items() if 7 <= i < 27)
    assert list(linked_pairs(*columns([]))) == [] == list(linked_pairs(*columns([[], []])))


def test_very_long_groups_cost_distinct_ids():
    assert flat(linked_pairs(*columns([[([1] * 100_000 + [2], [3] * 100_000)]]))) == [(0, 1, 3, 10**10), (0, 2, 3, 10**5)]


def corpus():
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([1, 8, 60])) for _ in range(40)] + ODD
    return [*enumerate(texts), *((100 + i, texts[3]) for i in range(60)), (None, texts[5]), (None, None), (2, texts[2]), (2, "other")]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_the_contract(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = [tuple(r[c] for c in NAMES) for r in QUERIES["op12_tokenizer_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(made, key=str) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("few", [0, 1, 40])
def test_rare_pairs_meet_their_counts_by_a_shuffle(spark, few):
    rows = corpus()
    aligned = align(frame(spark, rows, extra="key string, groups string, copies int, pair long, n_a string"), JSON, MODEL)
    want = {r.text_id: (r.n_best, r.count_sum) for r in aligned.link_sums().collect()}
    assert {r.text_id: (r.n_best, r.count_sum) for r in aligned.link_sums(few).collect()} == want and len(want) > 30
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows if t}
    assert {r.key: [(list(g.a), list(g.b)) for g in r.groups] for r in aligned.groups().collect()} == {k: brute_groups(t) for k, t in texts.items()}
    assert aligned.texts.count() == len({t for _, t in rows if t})
    assert align(frame(spark, []), JSON, MODEL).per_document("doc_id", "text").collect() == []


def test_string_ids_and_nothing_but_empty_texts(spark):
    made = align(spark.createDataFrame([("k", None), ("l", "")], "id string, body string"), JSON, MODEL, "id", "body").per_document("id", "body").collect()
    assert sorted((r.id, r.n_a, r.n_links, r.count_sum) for r in made) == [("k", 0, 0, 0), ("l", 0, 0, 0)]


def test_bytes_of_tokens(aligner):
    ids = np.array([0, 5, 5, 300, 50_000])
    for kind, each in ((aligner.a, [bytes(AS_BYTES[c] for c in LIBRARY.id_to_token(i)) for i in ids.tolist()]),):
        assert kind.bytes.at(ids).tobytes() == b"".join(each) and kind.bytes.sizes[ids].tolist() == [len(e) for e in each]


def test_a_last_single_space_is_a_token(aligner, spark, tmp_path):
    texts = ["hello ", "hello  ", ". . ", "日 ", "a\n ", " ", "hello"]
    assert listed(aligner.groups(texts)) == [brute_groups(t) for t in texts] and all(brute_groups(t) for t in texts)
    few = alignment.SentencePieces(MODEL, most=2)
    assert [np.frombuffer(ids, "<i4").tolist() for t in texts for ids in few.encode([" " + t])] == [PIECES.encode(t) for t in texts]
    rows = [*enumerate(texts), (90, texts[0]), (None, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = [tuple(r[c] for c in NAMES) for r in QUERIES["op12_tokenizer_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(made, key=str) == sorted(expected(rows), key=str)
