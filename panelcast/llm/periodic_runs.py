"""Periodic runs of words: suffix classes are united by falling common prefix, and new neighbours in a class seed runs."""

from __future__ import annotations

import itertools
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.common import mix, parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: str, most: int = 1 << 16) -> tuple[np.ndarray, list[str]]:
    """The words of ``text`` as numbers, and the distinct words by number; at most ``most`` words exist as a list at a time."""
    known: dict[str, int] = {}
    made = []
    found = (m.group() for m in WORD.finditer(text)) if len(text) > most else iter(WORD.findall(text))
    while block := list(itertools.islice(found, most)):
        made.append(np.array([known.setdefault(w, len(known)) for w in block], np.int64))
    return (np.concatenate(made) if made else np.empty(0, np.int64)), list(known)


def repeats(ids: np.ndarray, width: int) -> bool:
    """Whether a stretch of ``width`` numbers may occur twice; never false if one does."""
    count = len(ids) - width + 1
    if count < 2:
        return False
    values, sums = mix(ids.astype(np.uint64)), np.zeros(count, np.uint64)
    for i in range(width):
        sums = sums * _STEP + values[i : i + count]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def stretch_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Level k: equal ranks for equal stretches of 2**k numbers, in their order; ends when all stretches differ.

    A rank is the place of its class among the sorted stretches, so only classes with several members are sorted again.
    """
    n, width = len(ids), 1
    rank, active, levels = np.zeros(n, np.int64), np.arange(n), []
    key = ids
    while True:
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        place = np.arange(len(active))
        old, fresh = rank[active], np.append(True, key[1:] != key[:-1])
        old_start = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[active] = old + start - old_start
        levels.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
        if not len(active):
            return levels
        after = np.full(len(active), -1)
        inside = active + width < n
        after[inside] = rank[active[inside] + width]
        key = rank[active] * (n + 1) + after + 1
        width *= 2


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and at ``b``, by halving widths."""
    n, got = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + got, b + got
        inside = np.maximum(i, j) < n
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        got += same.astype(np.int64) << k
    return got


class Positions:
    """An ordered set in blocks, so that an insertion moves few entries however large the set is."""

    __slots__ = ("blocks", "heads", "size")
    BLOCK = 1024

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        return itertools.chain.from_iterable(self.blocks)

    def insert(self, x: int) -> tuple[int, int]:
        """Puts ``x`` in and returns its neighbours, -1 where there is none."""
        b = max(bisect(self.heads, x) - 1, 0)
        block = self.blocks[b]
        at = bisect(block, x)
        before = block[at - 1] if at else -1
        after = block[at] if at < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else -1
        block.insert(at, x)
        self.heads[b] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[b : b + 1] = block[: self.BLOCK], block[self.BLOCK :]
            self.heads[b : b + 1] = block[0], block[self.BLOCK]
        return before, after


def new_neighbours(order: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, common prefix) for positions that become neighbours when two classes are united.

    ``prefix[t]`` is the common prefix of ``order[t]`` and ``order[t + 1]``, 0 between classes. Edges go by falling
    prefix; the smaller of two classes moves into the larger one, so a position moves at most log n times.
    """
    places = order.tolist()
    root, sets = list(range(len(places))), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for t in np.argsort(-prefix, kind="stable").tolist():
        shared = int(prefix[t])
        if not shared:
            return
        u, v = find(t), find(t + 1)
        large, small = (sets.pop(x, None) or Positions(places[x]) for x in (u, v))
        if large.size < small.size:
            u, v, large, small = v, u, small, large
        moved, last = list(small), -1
        for x, following in itertools.zip_longest(moved, moved[1:], fillvalue=-1):
            before, after = large.insert(x)
            if before >= 0 and before != last:
                yield before, x, shared
            if after >= 0 and not 0 <= following < after:
                yield x, after, shared
            last = x
        root[v] = u
        sets[u] = large


def runs_of(ids: np.ndarray, min_length: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``ids``, by start and period.

    A run is a stretch of smallest period q, at least ``min_length`` long and ``min_repeats`` (two or more) times q,
    that neither neighbour extends. Its first two periods start at positions whose common prefix is the run's length
    less q. No position between them shares as much, or q would not be smallest; so they become neighbours in the
    union at just that prefix, and a pair of neighbours that the word before tells apart is a run.
    """
    least = max(1, -(-min_length * (min_repeats - 1) // min_repeats))
    if not repeats(ids, least):
        return []
    levels = stretch_ranks(ids)
    order = np.argsort(levels[-1], kind="stable")
    wide = levels[min(least.bit_length() - 1, len(levels) - 1)]
    alike = wide[order[1:]] == wide[order[:-1]]
    used = np.append(alike, False) | np.append(False, alike)
    order = order[used]
    prefix = common_prefix(levels, order[:-1], order[1:])
    prefix[prefix < least] = 0
    found = []
    for i, j, shared in new_neighbours(order, prefix):
        q = j - i
        if q <= shared and shared + q >= max(min_length, min_repeats * q) and (i == 0 or ids[i - 1] != ids[j - 1]):
            found.append((i, shared + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 24, min_repeats: int = 3) -> DataFrame:
    """One row per input row: id, ``runs`` (array of start, length, period in words) and ``collapsed``, the text without repeats.

    Words are separated by ASCII white space. ``collapsed`` leaves out the words that any run holds after its first
    period, and joins the others by one space. A null or empty text has no runs and collapses to ''. Repeated rows
    give repeated results; a null id stays null; other columns are not read. A text is read whole in one task: about
    100 bytes a word where stretches repeat.
    """
    docs = docs.select(id_column, text_column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in parts(frames):
            runs, texts = [], []
            for text in frame.column(1).to_pylist():
                ids, words = numbered(text or "")
                own = runs_of(ids, min_length, min_repeats)
                if own:
                    keep = np.ones(len(ids), bool)
                    for start, length, period in own:
                        keep[start + period : start + length] = False
                    ids = ids[keep]
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(" ".join(map(words.__getitem__, ids.tolist())))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())], names=[id_column, "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_column}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
