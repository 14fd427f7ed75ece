"""Benchmark decontamination by templates: values become typed slots, windows of templates are joined."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import Memo, batches, mix, parts, signed, written

#: Units that count as such after a number, and number words.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons l ml litre litres liter liters "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros "
    "cent cents degree degrees meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "tage tag stunden stunde jahre jahr jours jour heures heure ans kilos dias horas euros".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
TOKEN = re.compile(r"\d(?:[\d.,]*\d)?|[^\W\d]+|[%$€£]|[.!?\n]")
SLOTS = ("<num>", "<unit>", "<name>")
_END, _NUMBER, _UNIT, _SIGN, _NAME = (np.uint64(1 << i) for i in range(5))
_FLAGS = np.uint64(63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Rules:
    """``window`` template words are hashed together; a window needs ``literals`` words that are not slots.

    A text holds an item if ``coverage`` of the item's windows occur in it and ``consistency`` of their slots
    stand for one value each. ``most_keys``: item windows up to which texts are filtered in the scan (8 bytes
    each in every task); with more, all windows of texts go to the join.
    """

    window: int = 8
    literals: int = 4
    coverage: float = 0.5
    consistency: float = 0.7
    most_keys: int = 1 << 20


_FLAGS_OF = {t: int(_END) for t in ".!?\n"} | {t: int(_UNIT | _SIGN) for t in "%$€£"} | {t: int(_UNIT) for t in UNITS} | {t: int(_NUMBER) for t in NUMBER_WORDS}
_IS_NUMBER, _IS_NAME, _IS_HASH = int(_NUMBER), int(_NAME), ~int(_FLAGS)


def _known(token: str) -> int:
    """A hash of the token in lower case, and in the lowest six bits what the token can be."""
    low = token.lower()
    flags = _FLAGS_OF.get(low, 0)
    first = token[0]
    if first.isdigit():
        flags = _IS_NUMBER
    elif first.isupper() and len(token) > 1 and flags != _IS_NUMBER and not token.isupper():
        flags |= _IS_NAME
    return xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) & _IS_HASH | flags


class Templates:
    """Reads texts as templates: words, and typed slots in place of values.

    Numbers and number words are ``<num>``, units and signs after a number ``<unit>`` (other signs are left out),
    and capitalised words ``<name>`` if they are not the first of a sentence or occur capitalised elsewhere within one.
    """

    def __init__(self):
        self.known = Memo(_known, 1 << 17)

    def read(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, places of the template's words among them, kind of each: 0 or 1 + its slot, hash of its value)."""
        return self.readings(text)[:4]

    def readings(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``read``, which words of the template could be a name, and which of them are the first of a sentence."""
        tokens, _, *rest = self.of_texts([text])
        return tokens, *rest

    def of_texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``readings`` of some texts, one after the other, with the text of each word after the tokens."""
        found = [TOKEN.findall(t or "") for t in texts]
        tokens = found[0] if len(found) == 1 else list(chain.from_iterable(found))
        v = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        new = np.concatenate([[True], text[1:] != text[:-1]])[: len(v)]
        end = (v & _END) > 0
        first = new | np.concatenate([[True], end[:-1]])[: len(v)]
        at = np.flatnonzero(~end)
        v, first, text = v[at], first[at], text[at]
        number = (v & _NUMBER) > 0
        after = np.concatenate([[False], number[:-1] & (text[1:] == text[:-1])])[: len(v)]
        kind = np.zeros(len(v), np.int8)
        named = (v & _NAME) > 0
        if (inside := named & ~first).any():
            own = mix(v) + text.astype(np.uint64) * _BASE
            kind[named & np.isin(own, np.unique(own[inside]))] = 3
        kind[after & ((v & _UNIT) > 0)] = 2
        kind[number] = 1
        named &= (kind == 0) | (kind == 3)
        use = (kind > 0) | ((v & _SIGN) == 0)
        return tokens, text[use], at[use], kind[use], (v & ~_FLAGS)[use], named[use], (named & first)[use]


def template(text: str | None) -> list[str]:
    tokens, at, kind, _ = Templates().read(text)
    return [SLOTS[k - 1] if k else tokens[i].lower() for i, k in zip(at, kind, strict=True)]


class Windows:
    """Hashed template windows of texts; only those with a key in the sorted ``keep`` if given."""

    STEP = 4096

    def __init__(self, rules: Rules, keep: np.ndarray | None = None, sizes: frozenset[int] | None = None):
        self.rules, self.keep, self.sizes, self.templates = rules, keep, sizes, Templates()
        if keep is not None:
            self.likely = np.zeros(1 << 20, bool)
            self.likely[keep >> np.uint64(44)] = True
        # powers of the base and of its inverse: a window's key is a difference of running sums
        self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(self.STEP + rules.window, b))) for b in (_BASE, _INVERSE))
        self.whole = self.up * np.arange(len(self.up), dtype=np.uint64)

    def of(self, text: str | None) -> Iterator[tuple[int, int, int, list[int]]]:
        """(key, first word, words, hashed slot values) of each window with enough literal words.

        A text with fewer words than a window is one window. With ``sizes``, those of short items: windows of each
        size that the text has words for, and each in all readings: a capitalised word is a word or a name if it is the
        first of a sentence, or of the window, where an item may begin.
        """
        return (w[1:] for w in self.of_texts([text]))

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """``of`` for some texts together, the number of the text before each window."""
        _, text, _, kind, values, named, first = self.templates.of_texts(texts)
        words = np.bincount(text, minlength=len(texts))
        starts, most = np.cumsum(words) - words, self.rules.window
        if self.sizes is None:
            none = np.zeros(len(kind), bool)
            for size in np.unique(np.minimum(words, most)[words > 0]).tolist():
                yield from self._sized(text, starts, np.minimum(words, most) == size, kind, values, size, none, none)
            return
        for size in sorted({most, *self.sizes}):
            # shorter items could be anywhere: they are found as the whole text only
            mine = (words == size) | ((self.rules.literals <= size) & (size < words))
            if mine.any():
                yield from self._sized(text, starts, mine, kind, values, size, named, first)

    def _sized(
        self, text: np.ndarray, starts: np.ndarray, mine: np.ndarray, kind: np.ndarray, values: np.ndarray, size: int, named: np.ndarray, first: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """Windows of ``size`` words of the texts in ``mine``."""
        slot = kind > 0
        h = np.where(slot & ~first, kind.astype(np.uint64), values)
        change = np.uint64(3) - values
        for start in range(0, len(h) - size + 1, self.STEP):
            n = min(self.STEP, len(h) - size + 1 - start)
            at, names = np.arange(start, start + n), np.zeros(n, np.int64)
            own, one = slice(start, start + n + size - 1), slice(start, start + n)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h[own] * self.down[: n + size - 1], dtype=np.uint64)])
            head = np.where(named[one], values[one] - h[one], np.uint64(0))
            keys = self.whole[size] + (sums[size:] - sums[:-size]) * self.up[size - 1 : n + size - 1] + head * self.up[size - 1]
            plain = ~slot[own]
            words = np.concatenate([[0], np.cumsum(plain | first[own])])
            literal = words[size:] - words[:-size] + (named[one] & ~first[one] & ~plain[:n]) - (first[one] & ~named[one] & ~plain[:n])
            literal[(text[one] != text[start + size - 1 : start + size - 1 + n]) | ~mine[text[one]]] = -1  # beyond its text
            least = min(self.rules.literals, size)
            many = np.concatenate([[0], np.cumsum(first[start : start + n + size - 1])])
            several = np.flatnonzero(((many[size:] > many[:-size]) | named[at]) & (literal > least))
            use = np.flatnonzero(literal >= least)
            made = [(keys[use], names[use], at[use])]
            keys, literal, names, at = keys[several], literal[several], names[several], at[several]
            for i in range(size if len(several) else 0):
                more = np.flatnonzero((named if i == 0 else first)[at + i] & (literal > least))
                if not len(more):
                    continue
                new = keys[more] + change[at[more] + i] * self.up[size - 1 - i], names[more] | 1 << i, at[more]
                made.append(new)
                literal = np.concatenate([literal, literal[more] - 1])
                keys, names, at = (np.concatenate(c) for c in zip((keys, names, at), new, strict=True))
            keys, names, at = (np.concatenate(c) for c in zip(*made, strict=True))
            keys = mix(keys)
            if self.keep is not None:
                use = np.flatnonzero(self.likely[keys >> np.uint64(44)])
                if len(use):
                    near = np.minimum(np.searchsorted(self.keep, keys[use]), len(self.keep) - 1)
                    use = use[self.keep[near] == keys[use]]
                keys, names, at = keys[use], names[use], at[use]
            of = text[at]
            for t, i, there, key, mask in zip(of.tolist(), at.tolist(), (at - starts[of]).tolist(), signed(keys), names.tolist(), strict=True):
                slots = [k for k in range(i, i + size) if mask >> (k - i) & 1 or (slot[k] and not (named if k == i else first)[k])]
                yield t, key, there, size, signed(values[slots])


def windows(texts: DataFrame, id_column: str, text_column: str, rules: Rules, keep: np.ndarray | None = None, sizes: frozenset[int] | None = None) -> DataFrame:
    """(id, key, at, size, slots) of all template windows of ``texts``, or of those with a key in the sorted ``keep``.

    With ``sizes``, of texts that may hold items of these sizes, in all readings.
    """
    kind = texts.schema[id_column].dataType.simpleString()
    arrow = pa.schema([("id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.int64()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(rules, keep, sizes)

        def rows() -> Iterator[tuple]:
            for frame in parts(frames, 32):
                ids = frame.column(0).to_pylist()
                for t, *window in made.of_texts(frame.column(1).to_pylist()):
                    yield ids[t], *window

        return batches(rows(), arrow)

    return texts.select(id_column, text_column).mapInArrow(run, f"id {kind}, key long, at int, size int, slots array<long>")


def _chains(hits: list, drift: int) -> Iterator[list]:
    """Hits that may form one occurrence: those of each distance between item and text, and the longest run, increasing
    in both, over neighbouring distances, as words put in or left out shift the rest.
    """
    by: dict[int, list] = {}
    for h in hits:
        by.setdefault(h["here"] - h["there"], []).append(h)
    yield from by.values()
    near: list[list[int]] = []
    for shift in sorted(by):
        if near and shift - near[-1][-1] <= drift:
            near[-1].append(shift)
        else:
            near.append([shift])
    for shifts in near:
        if len(shifts) < 2:
            continue
        run = sorted((h for x in shifts for h in by[x]), key=lambda h: (h["there"], -h["here"]))
        ends, tails, before = [], [], [-1] * len(run)
        for i, h in enumerate(run):
            k = bisect_left(ends, h["here"])
            before[i] = tails[k - 1] if k else -1
            ends[k : k + 1], tails[k : k + 1] = [h["here"]], [i]
        chain, i = [], tails[-1]
        while i >= 0:
            chain.append(run[i])
            i = before[i]
        yield chain


def _evidence(rules: Rules):
    """Of the hits of an item in a text: distinct item windows, slots, and slots that keep to one value.

    The best occurrence counts: one whose slots keep to their values before others, then the one with most windows.
    """

    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in parts:
            out = []
            for hits in column:
                best = (False, 0, 0, 0)
                for run in _chains(hits, rules.window):
                    pairs = {(a, b) for h in run for a, b in zip(h["theirs"], h["own"], strict=True)}
                    left, right = {}, {}
                    for a, b in pairs:
                        left.setdefault(a, set()).add(b)
                        right.setdefault(b, set()).add(a)
                    good = sum(len(left[a]) == 1 and len(right[b]) == 1 for a, b in pairs)
                    best = max(best, (good >= rules.consistency * len(pairs), len({h["there"] for h in run}), good - len(pairs), len(pairs)))
                out.append((best[1], best[3], best[3] + best[2]))
            yield pd.DataFrame(out, columns=["windows", "slots", "consistent"])

    return rate


def contaminated(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, windows, coverage, slots, consistency): texts that hold a benchmark item, also with other values.

    Coverage is the share of the item's windows found in one occurrence; consistency the share of its distinct
    (item value, text value) pairs that match one to one, 1 without slots. Items without a window (no text, or
    too few literal words) are never found; items of fewer words than ``literals`` only as the whole text. Null texts hold nothing; rows with a null id are left out, as they
    cannot be named; repeated rows give one result per (id, item). Other columns are not read.
    """
    known = written(windows(items, item_column, item_text, rules).where("id is not null").dropDuplicates(["id", "at"]), "item-windows")
    keys = known.select("key").distinct()
    keep = None
    if keys.limit(rules.most_keys + 1).count() <= rules.most_keys:
        keep = np.sort(np.array([r.key for r in keys.collect()], np.int64).view(np.uint64))
    sizes = frozenset(r[0] for r in known.select("size").distinct().collect())
    found = windows(docs.where(F.col(id_column).isNotNull()), id_column, text_column, rules, keep, sizes)
    theirs = known.select(F.col("id").alias("item"), "key", F.col("at").alias("there"), F.col("slots").alias("theirs"))
    sizes = known.groupBy("id").agg(F.count("*").alias("total")).withColumnRenamed("id", "item")
    hits = found.join(theirs, "key").where(F.size("slots") == F.size("theirs"))
    runs = hits.groupBy("id", "item").agg(F.collect_list(F.struct(F.col("at").alias("here"), "there", F.col("slots").alias("own"), "theirs")).alias("hits"))
    evidence = F.pandas_udf(_evidence(rules), "windows int, slots int, consistent int").asNondeterministic()  # rated once
    rated = runs.select("id", "item", evidence("hits").alias("e")).join(sizes, "item").select(
        F.col("id").alias(id_column),
        F.col("item").alias(item_column),
        F.col("e.windows").cast("long").alias("windows"),
        (F.col("e.windows") / F.col("total")).alias("coverage"),
        F.col("e.slots").cast("long").alias("slots"),
        F.when(F.col("e.slots") == 0, 1.0).otherwise(F.col("e.consistent") / F.col("e.slots")).alias("consistency"),
    )
    return rated.where((F.col("coverage") >= rules.coverage) & (F.col("consistency") >= rules.consistency))
