import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpus import frame
from panelcast.llm.packing import Sequences, TokenBytes, pack_documents, pack_with_vocabulary
from panelcast.llm.token_counts import MergeCounter, count_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
COUNTER, BYTES = MergeCounter(VOCABULARY), TokenBytes(VOCABULARY)
ODD = [None, "", " ", "\n\n  \t x", "it's I'LL we'd 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "4５６ ½² 日本語 😀‍😀 é", "a" * 30_000, " " * 30_000, "ab" * 20_000, "!?" * 500]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_equal_the_library(text):
    assert COUNTER.count(text) == len(ids(text))
    assert np.frombuffer(b"".join(BYTES.encode(text)), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text or "") == len(ids(text))
    assert np.frombuffer(b"".join(BYTES.encode(text or "")), "<u4").tolist() == ids(text)


def test_a_text_is_encoded_in_few_calls(monkeypatch):
    texts = [" ".join(f"word{i} {i}," for i in range(20_000)), "a<|endoftext|>b \n\n c", "x" * 300_000 + " y z"]
    coder, calls = TokenBytes(VOCABULARY), []
    encode = coder.text
    monkeypatch.setattr(coder, "text", lambda part: calls.append(part) or encode(part))
    for text, most in zip(texts, (2, 2, 2), strict=True):
        calls.clear()
        assert np.frombuffer(b"".join(coder.encode(text)), "<u4").tolist() == ids(text)
        assert len(calls) <= most


def test_count_table(spark):
    rows = [*enumerate(ODD), (None, "null id"), (0, None)]
    made = count_tokens(frame(spark, rows), VOCABULARY).collect()
    assert sorted(map(str, made)) == sorted(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={len(ids(t))})" for i, t in rows)
    assert count_tokens(frame(spark, []), VOCABULARY).collect() == []


def check(rows, made, size=1024):
    pieces, at = defaultdict(list), defaultdict(list)
    for r in made:
        pieces[r.doc_id].append(r)
        at[r.sequence_id].append(r)
    want = {i: [*ids(t), 0] for i, t in rows}
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(want[i]) == own[0].doc_tokens
        end = 0
        for r in own:
            assert r.start == end
            end += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][r.start : end], "<u4").tobytes())
    for own in at.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= size and total & (total - 1) == 0  # nothing is padded


def test_packing_is_a_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    for partitions in (1, 3):
        check(rows, pack_with_vocabulary(frame(spark, rows).repartition(partitions, "doc_id"), VOCABULARY).collect())
    assert pack_with_vocabulary(frame(spark, []), VOCABULARY).collect() == []


def test_null_and_repeated_ids(spark):
    made = pack_with_vocabulary(frame(spark, [(None, "x"), (None, None), (1, "y"), (1, "y")]), VOCABULARY).collect()
    assert sorted((r.doc_id or -1, r.length) for r in made) == [(-1, 1), (-1, 2), (1, 2), (1, 2)]


def test_each_piece_goes_where_squares_grow_least():
    rng = np.random.default_rng(2)
    size, made = 16, Sequences(16, 0)
    levels = np.zeros(17, int)
    for i in range(400):
        s = int(rng.integers(1, 17))
        before = made.levels.copy()
        list(made.place(i, 0, b"\1\0\0\0" * s, s))
        options = {0: 1} | {h: 1 for h in range(1, 17 - s) if before[h]} | ({16 - s: 1} if before[16 - s] else {})
        best = []
        for h in options if s < 16 else [0]:
            levels = before.copy()
            levels[h] -= h > 0
            if h + s < 16:
                levels[h + s] += 1
            best.append((levels[1:16] ** 2).sum())
        assert (made.levels[1:16] ** 2).sum() == min(best)
    assert size == 16


def test_open_sequences_are_bounded(spark):
    made = Sequences(1024, 0, most_open=3)
    out = [r for i in range(50) for r in made.place(i, 0, b"\0\0\0\1" * 600, 600)] + list(made.settle())
    assert sum(r[2] for r in out) == 50 * 600 and made.held == 0
    df = pack_documents(frame(spark, [(1, "abc")]), lambda: lambda t: iter([t.encode("utf-32-le")]), 4, 9)
    assert df.collect()[0].length == 4
