"""Alignment of two tokenisations: each distinct text is tokenised and aligned once, pairs count once per copy."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm.common import FEW_ROWS, parts
from panelcast.llm.token_counts import PIECES, byte_symbols, stretches
from panelcast.sources.shared import new_path, written

CHUNK, MOST_PAIRS, WIDE = 1 << 20, 1 << 22, 64
#: Ids of both vocabularies stay below 2 to this power.
ID_BITS = 24


class Bytes:
    """The bytes of each token id; ``at`` gives those of a row of ids together."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def at(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.starts[ids], sizes) + within]


class ByteLevel:
    """A byte-level byte-pair vocabulary file (.json) without special tokens: their strings are plain text.

    Where ids follow the order of merges, the same merges run in the faster library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        as_bytes = {i: bytes(symbols[c] for c in t) for t, i in ids.items() if set(t) <= symbols.keys()}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes = Bytes([as_bytes.get(i, added.get(i, b"")) for i in range(self.library.get_vocab_size())])
        order = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        self.fast = None
        if plain and all(c in ids for c in symbols) and order == sorted(set(order)) and max(ids[c] for c in symbols) < order[0]:
            ranks = {as_bytes[i]: i for i in {*order, *(ids[c] for c in symbols)}}
            self.fast = tiktoken.Encoding("whole", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit values."""
        return [b"".join(np.array(self._one(part), "<i4").tobytes() for part in stretches(t)) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # its pattern gives up on very long runs of white space
                pass
        return self.library.encode(text, add_special_tokens=False).ids


class SentencePieces:
    """A sentencepiece model file; a piece in UTF-8 with U+2581 as a space, <0xHH> as a byte.

    Where no piece has a space after another character, a text is encoded by units, a run of spaces and what follows
    up to the next; each distinct short unit is encoded once.
    """

    UNIT = re.compile(r" +[^ ]*|[^ ]+")

    def __init__(self, path: str, most: int = 1 << 18, short: int = 64):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        #: A last single space is a unit of its own, and the library adds no space to an empty text.
        last = self.library.encode("a ")[len(self.library.encode("a")) :]
        self.last_space = {" ": np.array(last, "<i4").tobytes()}
        self.known, self.most, self.short = dict(self.last_space), most, short

    def _raw(self, units: list[str]) -> list[bytes]:
        """Ids of texts that begin with the space that the library adds itself."""
        return [np.array(ids, "<i4").tobytes() for ids in self.library.encode([u[1:] for u in units], num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self._raw(texts)
        cut = [self.UNIT.findall(t) for t in texts]
        new = [u for u in set().union(*cut) if u not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = dict(self.last_space)
            new = [u for u in set().union(*cut) if u not in self.known]
        made = dict(zip(new, self._raw(new), strict=True))
        self.known.update((u, ids) for u, ids in made.items() if len(u) <= self.short)
        both = self.known | made if any(len(u) > self.short for u in new) else self.known
        return [b"".join(map(both.__getitem__, units)) for units in cut]


@dataclass(slots=True)
class Groups:
    """Token ids of some texts by group; ``of_text`` and ``a_of``, ``b_of`` are offsets of groups and of tokens."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    of_text: np.ndarray


Measure = Callable[[Groups], list[str]]


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), SentencePieces(pieces)
        if max(len(self.a.bytes.sizes), len(self.b.bytes.sizes)) > 1 << ID_BITS:
            raise ValueError("vocabularies of this size are not supported")

    def groups(self, texts: list[str]) -> Groups:
        """Groups between the byte offsets where tokens of both kinds end; a text whose bytes either side changes has none."""
        spaced = [" " + t for t in texts]
        raw = [t.encode("utf-8", "replace") for t in spaced]
        size = np.array([len(r) for r in raw], np.int64)
        good, found = size > 1, []
        for kind in (self.a, self.b):
            ids = kind.encode(spaced)
            own = np.repeat(np.arange(len(texts)), [len(i) // 4 for i in ids])
            flat = np.frombuffer(b"".join(ids), "<i4").astype(np.int64)
            good &= np.bincount(own, kind.bytes.sizes[flat], len(texts)) == size
            found.append((flat, own, kind))
        for flat, own, kind in found:
            kept = np.flatnonzero(good)
            differ = kind.bytes.at(flat[good[own]]) != np.frombuffer(b"".join(raw[k] for k in kept), np.uint8)
            good[np.repeat(kept, size[kept])[differ]] = False
        kept = np.flatnonzero(good)
        both = [flat[good[own]] for flat, own, _ in found]
        ends = [np.cumsum(kind.bytes.sizes[flat]) for flat, kind in zip(both, (self.a, self.b), strict=True)]
        marks = np.zeros((2, int(size[kept].sum()) + 1), bool)
        for mark, end in zip(marks, ends, strict=True):
            mark[end] = True
        shared = np.flatnonzero(marks[0] & marks[1])
        per_text = np.zeros(len(texts), np.int64)
        per_text[kept] = np.diff(np.append(0, np.searchsorted(shared, np.cumsum(size[kept]), "right")))
        a_of, b_of = (np.append(0, np.searchsorted(end, shared, "right")) for end in ends)
        return Groups(*both, a_of, b_of, np.append(0, np.cumsum(per_text)))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
IDS = ("a", "b", "shape")


def align_texts(texts: DataFrame, byte_level: str, pieces: str, measures: Mapping[str, Measure]) -> DataFrame:
    """``texts`` (key, text, copies) with counts, ``measures`` and the aligned ids in place of the text.

    ``a`` and ``b`` are ids and ``shape`` the numbers of both in each group, as little-endian 32-bit values: columns of
    bytes pass between Spark and Python whole.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces)
        for frame in parts(frames, 512):
            at = 0
            for held in _chunks(frame.column(1).to_pylist()):
                g = aligner.groups(held)
                na, nb = np.diff(g.a_of), np.diff(g.b_of)
                before = np.append(0, np.cumsum(na * nb))
                counts = [np.diff(x) for x in (g.a_of[g.of_text], g.b_of[g.of_text], g.of_text, before[g.of_text])]
                shape = np.column_stack([na, nb]).astype("<i4")
                cut = [(ids.astype("<i4"), of[g.of_text].tolist()) for ids, of in ((g.a, g.a_of), (g.b, g.b_of), (shape, np.arange(len(shape) + 1)))]
                made = [pa.array([ids[s:e].tobytes() for s, e in zip(of, of[1:], strict=False)], pa.binary()) for ids, of in cut]
                rows = frame.slice(at, len(held))
                own = [pa.array(m(g), pa.string()) for m in measures.values()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *map(pa.array, counts), *own, *made], names=["key", "copies", *COUNTS, *measures, *IDS])
                at += len(held)

    schema = ["key string", "copies long", *(f"{c} long" for c in COUNTS), *(f"`{m}` string" for m in measures), *(f"{c} binary" for c in IDS)]
    return texts.select("key", "text", "copies").mapInArrow(run, ", ".join(schema))


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of 32-bit values, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<i4") if data else np.empty(0, "<i4")
    return flat.astype(np.int64), np.diff(offsets) // 4


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each stretch, one stretch after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def linked_pairs(a: pa.Array, b: pa.Array, shape: pa.Array, most: int = MOST_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, pair, links) of the id pairs linked in each row; a pair is a << 24 | b, once per row.

    In groups of many links the ids are counted first, so such a group costs its distinct ids and not its occurrences;
    rows with more than ``most`` links come in shares of the first id.
    """
    (ids_a, _), (ids_b, _), (sizes, per_row) = _ints(a), _ints(b), _ints(shape)
    na, nb = (np.ascontiguousarray(c) for c in sizes.reshape(-1, 2).T)
    group_ends = np.append(0, np.cumsum(per_row // 2))
    row_of = np.repeat(np.arange(len(per_row)), per_row // 2)
    sides = [[ids, None, np.cumsum(n) - n, n.copy()] for ids, n in ((ids_a, na), (ids_b, nb))]
    if len(wide := np.flatnonzero(na * nb > WIDE)):
        for side in sides:
            ids, _, start, n = side
            counted = [np.unique(ids[start[g] : start[g] + n[g]], return_counts=True) for g in wide.tolist()]
            side[0] = np.concatenate([ids, *(u for u, _ in counted)])
            side[1] = np.concatenate([np.ones(len(ids), np.int64), *(c for _, c in counted)])
            n[wide] = [len(u) for u, _ in counted]
            start[wide] = len(ids) + np.cumsum(n[wide]) - n[wide]
    (ids_a, times_a, start_a, na), (ids_b, times_b, start_b, nb) = sides
    before = np.append(0, np.cumsum(na * nb))[group_ends]
    at, last = 0, len(per_row)
    while at < last:
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        shares = max(1, -(-int(before[at + 1] - before[at]) // most)) if to == at + 1 else 1
        groups = np.arange(group_ends[at], group_ends[to])
        tokens, group = _places(start_a[groups], na[groups]), np.repeat(groups, na[groups])
        for share in range(shares):
            if shares > 1:
                mine = ids_a[tokens] % shares == share
                own, of = tokens[mine], group[mine]
            else:
                own, of = tokens, group
            width = nb[of]
            left, right = np.repeat((row_of[of] << 2 * ID_BITS) | (ids_a[own] << ID_BITS), width), _places(start_b[of], width)
            keys = left | ids_b[right]
            if not len(keys):
                continue
            if times_a is None:
                keys.sort()
                fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n = np.diff(np.append(fresh, len(keys)))
            else:
                order = np.argsort(keys)
                keys = keys[order]
                fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n = np.add.reduceat((np.repeat(times_a[own], width) * times_b[right])[order], fresh)
            keys = keys[fresh]
            yield keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), n
        at = to


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count): in how many documents each id pair is linked; tasks add up their own texts, copies as weights."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(pairs)
            order = np.argsort(keys)
            keys = keys[order]
            fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[fresh], np.add.reduceat(np.concatenate(sums)[order], fresh)

        for frame in parts(frames, 256):
            copies = frame.column(0).to_numpy()
            for row, pair, _ in linked_pairs(*frame.columns[1:]):
                pairs.append(pair)
                sums.append(copies[row])
                size += len(pair)
            if size > MOST_PAIRS:
                keys, out = merged()
                if len(keys) > MOST_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], names=["pair", "n"])
                    keys, out = keys[:0], out[:0]
                pairs, sums, size = [keys], [out], len(keys)
        if size:
            keys, out = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], names=["pair", "n"])

    return aligned.select("copies", *IDS).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))


@dataclass(frozen=True)
class Alignment:
    """``texts`` (text_id, key, copies, counts, measures, ids) and ``pairs`` (pair, count, best), both written.

    ``pair`` is a << 24 | b; ``count`` the documents that hold it linked; ``best`` whether no pair of the same a counts more.
    """

    docs: DataFrame
    texts: DataFrame
    pairs: DataFrame

    def link_sums(self, few: int = FEW_ROWS) -> DataFrame:
        """(text_id, n_best, count_sum) over the links of each text.

        Pairs meet their counts by a broadcast of the most frequent ones, at most ``few`` rows; the rest, without the
        pairs that half of all texts share, is joined by a shuffle.
        """

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in parts(frames, 256):
                ids = frame.column(0).to_numpy()
                for row, pair, n in linked_pairs(*frame.columns[1:]):
                    for i in range(0, len(row), 1 << 16):
                        cut = slice(i, i + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row[cut]]), pa.array(pair[cut]), pa.array(n[cut])], names=["text_id", "pair", "n"])

        links = self.texts.select("text_id", *IDS).mapInArrow(run, "text_id long, pair long, n long")
        level = F.floor(F.log2("count"))
        held, least = 0, None
        for r in self.pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a row per power of two
            held += r.n
            if held > few:
                break
            least = r.level
        else:
            least = 0

        def summed(rows: DataFrame) -> DataFrame:
            return rows.groupBy("text_id").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

        if least is None:
            return summed(links.join(self.pairs, "pair"))
        frequent = F.broadcast(self.pairs.where(level >= least))
        sums = summed(links.join(frequent, "pair"))
        if least > 0:
            rest = links.join(frequent.select("pair"), "pair", "left_anti").join(self.pairs.where(level < least), "pair")
            sums = sums.unionByName(summed(rest)).groupBy("text_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return sums

    def groups(self) -> DataFrame:
        """(key, groups) of each distinct text: its groups of aligned ids in order."""

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in parts(frames, 256):
                (a, _), (b, _), (sizes, per_row) = map(_ints, frame.columns[1:])
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32())) for ids, n in zip((a, b), sizes.reshape(-1, 2).T, strict=True)]
                made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row // 2)), pa.int32()), pa.StructArray.from_arrays(lists, names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([frame.column(0), made], names=["key", "groups"])

        return self.texts.select("key", *IDS).mapInArrow(run, "key string, groups array<struct<a: array<int>, b: array<int>>>")

    def per_document(self, id_column: str, text_column: str) -> DataFrame:
        """One row per document: id, n_a, n_b, n_groups, n_links, the measures, n_best and count_sum; 0 and '' without tokens.

        The measures of a text that more than a thousandth of all documents share are broadcast (so at most a thousand
        rows); all others meet their documents by a shuffle of digests.
        """
        own = self.texts.drop(*IDS)
        own = written(own.join(self.link_sums(), "text_id", "left"), "alignment-measures").drop("text_id")
        own = own.select("*", F.lit(True).alias("_found"))
        docs = self.docs.select(F.col(f"`{id_column}`"), text_key(F.col(f"`{text_column}`")).alias("_key"))
        total = own.agg(F.sum("copies")).first()[0] or 0
        shared = F.col("copies") * 1000 >= total
        names = [n for n in own.columns if n not in ("key", "copies")]

        def side(rows: DataFrame, mark: str) -> DataFrame:
            return rows.select(F.col("key").alias(f"_{mark}"), *[F.col(n).alias(f"_{mark}_{n}") for n in names])

        spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(id_column), F.lit(4096)).cast("string"))
        first = docs.join(F.broadcast(side(own.where(shared), "hot")), F.col("_key") == F.col("_hot"), "left")
        first = first.withColumn("_rest", F.when(F.col("_key").isNotNull() & F.col("_hot").isNull(), F.col("_key")).otherwise(spread))
        made = first.join(side(own.where(~shared), "cold"), F.col("_rest") == F.col("_cold"), "left")
        kinds = dict(own.dtypes)
        value = {n: F.coalesce(f"_hot_{n}", f"_cold_{n}", F.lit(0 if kinds[n] == "bigint" else "").cast(kinds[n])) for n in names if n != "_found"}
        return made.select(F.col(f"`{id_column}`"), *[c.alias(n) for n, c in value.items()])


def text_key(text: Column) -> Column:
    """A digest of a text that is not empty."""
    return F.when(F.length(text) > 0, F.sha2(text, 256))


def _written_small(df: DataFrame, name: str) -> DataFrame:
    """``written`` with stronger compression: ids in 32 bits are half zeros."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align(
    docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text", measures: Mapping[str, Measure] = {}
) -> Alignment:
    """Tokenises and aligns each distinct text of ``docs`` once.

    ``byte_level`` (A, encodes a space and the text) and ``pieces`` (B, adds that space itself) are paths of a byte-level
    vocabulary (.json) and a sentencepiece model that every executor can read. The byte offsets where tokens of both end
    cut them into groups; tokens are linked to all tokens of the other kind in their group. Texts are shuffled once, as
    text and number of copies, added up before the shuffle. A null or empty text, or one whose bytes either tokeniser
    changes, has no groups. ``measures``: further columns, from the groups of some texts to a string for each. Repeated rows and rows with a null id count as documents; other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    texts = docs.where(F.length(text_column) > 0).groupBy(F.col(f"`{text_column}`").alias("text")).agg(F.count("*").alias("copies"))
    aligned = align_texts(texts.select(text_key(F.col("text")).alias("key"), "text", "copies"), byte_level, pieces, measures)
    made = _written_small(aligned.select(F.monotonically_increasing_id().alias("text_id"), "*"), "alignment-texts")
    counted = written(pair_counts(made), "alignment-counts")
    first = F.shiftright("pair", ID_BITS)
    highest = written(counted.groupBy(first.alias("_a")).agg(F.max("count").alias("_most")), "alignment-highest")  # a row per token of A
    best = counted.join(F.broadcast(highest), first == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    return Alignment(docs, made, written(best, "alignment-pairs"))
