"""Packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from panelcast.llm.common import batches, parts
from panelcast.llm.token_counts import PIECES, Pieces, byte_symbols, stretches


def text_encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a text without special strings. Where ids follow the order of merges, the same merges run in the faster library."""
    library = Tokenizer.from_file(path)
    slow = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    order = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    symbols = {c: b for b, c in enumerate(byte_symbols())}
    if not all(c in ids for c in symbols) or order != sorted(set(order)) or max(ids[c] for c in symbols) >= order[0]:
        return slow
    merged = set(order)
    ranks = {bytes(symbols[c] for c in token): i for token, i in ids.items() if set(token) <= symbols.keys() and (len(token) == 1 or i in merged)}
    fast = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        try:
            return np.array(fast.encode_ordinary(text), "<u4").tobytes()
        except ValueError:  # its pattern gives up on very long runs of white space
            return slow(text)

    return encode


class TokenBytes:
    """Ids of a text as little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        added = Tokenizer.from_file(path).get_added_tokens_decoder()
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.pieces = Pieces(list(self.special))
        self.text = text_encoder(path)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of the whole text, a bounded part at a time."""
        between, specials = self.pieces.spans(text)
        for i, stretch in enumerate(between):
            yield from map(self.text, stretches(stretch))
            if i < len(specials):
                yield self.special[specials[i]]


class Sequences:
    """Open sequences by fill level; each piece goes where the sum of squared level counts grows least.

    ``levels[h]`` counts the open sequences filled to h. A piece of s ids on a sequence at h moves one count
    from h to h + s, or removes it when the sequence is full. Only open sequences are held; their number is
    bounded by ``most_open``, beyond which all open ones are settled.
    """

    def __init__(self, size: int, first: int, most_open: int = 4096):
        self.size, self.next, self.most_open = size, first, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.held = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next, at
            at += n
        self.next += 1

    def place(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        s, levels, size = len(ids) // 4, self.levels, self.size
        if s == size:
            yield from self._close([(doc, start, ids, total)])
            return
        grow = 2 * (levels[s : size + 1] - levels[: size - s + 1]) + 2
        grow[size - s] = 1 - 2 * levels[size - s]
        grow[0] = 2 * levels[s] + 1
        grow[1:][levels[1 : size - s + 1] == 0] = np.iinfo(np.int64).max
        h = size - s - int(np.argmin(grow[::-1]))  # the fullest of equals
        pieces = self.open[h].pop() if h else []
        pieces.append((doc, start, ids, total))
        if h:
            levels[h] -= 1
            self.held -= 1
        if h + s == size:
            yield from self._close(pieces)
            return
        levels[h + s] += 1
        self.open[h + s].append(pieces)
        self.held += 1
        if self.held > self.most_open:
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Cuts what is still open into full sequences, and the rest into powers of two."""
        rest = [p for level in self.open for pieces in level for p in pieces]
        left = sum(len(ids) // 4 for _, _, ids, _ in rest)
        self.open, self.held = [[] for _ in range(self.size + 1)], 0
        self.levels[:] = 0
        target = self._target(left)
        group, filled = [], 0
        for doc, start, ids, total in rest:
            while ids:
                cut = ids[: 4 * (target - filled)]
                group.append((doc, start, cut, total))
                n = len(cut) // 4
                start, ids, filled, left = start + n, ids[len(cut) :], filled + n, left - n
                if filled == target:
                    yield from self._close(group)
                    group, filled, target = [], 0, self._target(left)

    def _target(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)


def pack_documents(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], Iterator[bytes]]],
    size: int = 1024,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``encoder`` makes, in each task, a function from a text to its ids as little-endian unsigned 32-bit values
    in parts. A document's ids and then ``end_id`` are cut into pieces of ``size`` ids; the last, shorter one is
    placed online. Sequences are packed within a partition of ``docs`` and numbered by (partition, order), so a
    lost task gives the same sequences again and nothing is shuffled. At the end of a partition what is still
    open is cut into full sequences and into powers of two: no id is padding. A null or empty text is ``end_id``
    alone; repeated rows are packed as often as they occur; a null id stays null; other columns are not read.
    """
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([(id_column, arrow), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    end = np.array([end_id], "<u4").tobytes()

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder()
        sequences = Sequences(size, TaskContext.get().partitionId() << 40)
        for frame in parts(frames):
            for doc, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                ids = b"".join([*encode(text or ""), end])
                total = len(ids) // 4
                for start in range(0, total, size):
                    yield from sequences.place(doc, start, ids[4 * start : 4 * (start + size)], total)
        yield from sequences.settle()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(pieces(frames), schema)

    return docs.mapInArrow(run, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_with_vocabulary(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """``pack_documents`` with a tokeniser file (.json) that every executor can read."""
    return pack_documents(docs, lambda: TokenBytes(vocabulary).encode, size, end_id)
