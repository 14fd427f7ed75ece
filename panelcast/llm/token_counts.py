"""Token counts by byte-pair merging on a heap and a linked list; no token ids are made."""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelcast.llm.common import Memo, parts

#: The pre-tokeniser of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between ASCII letters: pre-tokens begin there.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
PART = 1 << 18


def byte_symbols() -> str:
    """The printable stand-in of each byte in a byte-level vocabulary, by byte value."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = itertools.count(256)
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


def stretches(text: str, most: int = PART) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut only where no byte-level token can reach over."""
    out, start = [], 0
    while len(text) - start > most and (found := _CUT.search(text, start + most)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class Pieces:
    """Cuts a text into special strings and pre-tokens."""

    def __init__(self, specials: list[str]):
        self.pattern = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def spans(self, text: str) -> tuple[list[str], list[str]]:
        """The stretches between special strings, and those strings."""
        if self.specials is None:
            return [text], []
        return self.specials.split(text), self.specials.findall(text)

    def blocks(self, text: str, most: int = 1 << 16) -> Iterator[list[str]]:
        """Pre-tokens of a stretch without special strings, a bounded list at a time."""
        if len(text) <= most:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(itertools.islice(found, most)):
            yield block


class MergeCounter:
    """Counts the tokens of a byte-level byte-pair vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.symbols = dict(enumerate(byte_symbols()))
        self.pieces = Pieces([t["content"] for t in spec["added_tokens"]])
        self.counts = Memo(self.merged)

    def merged(self, piece: str) -> int:
        """Initial symbols less merges: the lowest-ranked adjacent pair goes first, the leftmost among equals."""
        parts: list[str | None] = list(piece.encode("utf-8", "replace").decode("latin-1").translate(self.symbols))
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(itertools.pairwise(parts)) if pair in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one side has changed since
            parts[i], parts[j] = a + b, None
            merges += 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (pair := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if before[i] >= 0 and (pair := (parts[before[i]], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], before[i], *pair))
        return n - merges

    def count(self, text: str) -> int:
        stretches, specials = self.pieces.spans(text)
        counted = self.counts.__getitem__
        return len(specials) + sum(sum(map(counted, block)) for s in stretches for block in self.pieces.blocks(s))


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, UTF-8 bytes and tokens of the whole text.

    ``vocabulary``: path of a byte-level byte-pair vocabulary that every executor can read. Strings of its
    added tokens count one token each wherever they stand. A null or empty text has 0 bytes and 0 tokens;
    repeated rows give repeated results; a null id stays null; other columns are not read. An id has the
    type it has in ``docs``.
    """
    docs = docs.select(id_column, text_column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(vocabulary)
        for frame in parts(frames):
            texts = [t or "" for t in frame.column(1).to_pylist()]
            sizes = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([frame.column(0), sizes, pa.array(map(counter.count, texts), pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
