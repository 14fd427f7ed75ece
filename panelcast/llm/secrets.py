"""Secret scans: fixed patterns, and literals that flow into sensitive names through assignments."""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.common import parts

# The base patterns, letters of the assignment words in either case (ASCII).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGNED = 12
KINDS = ("assign", "access", "hex", "literal")

# How sensitive the parts of a name are, alone or in sequence.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "authorization": 0.8, "bearer": 0.8,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9,
    ("auth", "key"): 0.9, ("account", "key"): 0.9, ("storage", "key"): 0.8, ("connection", "string"): 0.7,
}
#: Last parts that make a name speak about a secret rather than hold one.
ABOUT = frozenset("length len size count type name names url uri path file field id label hint policy expiry expires ttl prefix regex pattern enabled required".split())
PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|dummy|redacted|your[_-]|insert[_-]|^(?:todo|none|null|undefined)$|^(.)\1*$|^<.*>$")
#: Literals of more characters are no secrets of the kinds scored here.
LONGEST = 4096

_NAME = r"(?>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*)"
_MORE = rf"{{0,{LONGEST}}}+"
_THREE = "|".join(q * 3 + rf"(?:[^{q}\\]|\\.){_MORE}" + q * 3 for q in "\"'")
_QUOTED = rf"{_THREE}|'(?:[^'\\\n]|\\.){_MORE}'|\"(?:[^\"\\\n]|\\.){_MORE}\"|`(?:[^`\\]|\\.){_MORE}`"
#: A target, an assignment sign and the first term of a value: quoted, ``$reference`` or bare. The target may be quoted, subscripted or typed.
STATEMENT = re.compile(
    rf"(?<![\w$.])(?<!\w-)(?<!->)(?<!::)(?P<name>{_NAME})(?:[\"']?\]?(?:[ \t]*:[ \t]*[A-Za-z_][\w\[\], .]{{0,40}}?(?=[ \t]*=[^=]))?)[ \t]*(?P<sign>:=|=>|\?=|\+=|=(?![=~>])|:(?![:=]))[ \t]*"
    rf"(?P<value>(?:[A-Za-z]{{1,2}}(?=[\"']))?(?P<quoted>{_QUOTED})|(?P<bare>[^\s,;()\[\]<>\"'`#]{{1,{LONGEST}}}+))",
    re.ASCII | re.DOTALL,
)
#: Arguments of calls that set a value by name: set("name", "value"), define('NAME', 'value').
CALL = re.compile(rf"""(?<!\w)(?:set|put|define|setenv|putenv|add|environ|getenv)[\w.]{{0,40}}\([ \t]*["'](?P<name>{_NAME})["'][ \t]*,[ \t]*(?P<value>(?P<quoted>{_QUOTED})|(?P<bare>{_NAME}))""", re.ASCII | re.DOTALL | re.IGNORECASE)
#: A further term of the same value, after a sign of concatenation or beside a quoted one.
FURTHER = re.compile(rf"[ \t]*(?:\+|\.\.|\\\n|(?=[\"']))[ \t]*(?P<value>(?P<quoted>{_QUOTED})|(?P<bare>{_NAME}))", re.ASCII | re.DOTALL)
REFERENCE = re.compile(rf"\$?\{{?\{{?(?:env\.|vars?\.|local\.|self\.|this\.)?({_NAME})\}}?\}}?", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BARE_LITERAL = re.compile(r"[A-Za-z0-9+/_=.\-!@%^&*~]+")
#: Letters of which every sensitive name holds some.
_HINTS = re.compile("pass|pwd|secret|token|key|credential|auth|bearer|string", re.IGNORECASE | re.ASCII)


@dataclass(slots=True)
class Binding:
    """A name, where it is bound, the literal spans of its value, and the names that the value refers to.

    ``bare``: the value is one bare word, a literal only if no name in the text is spelled like it.
    """

    name: str
    at: int
    literals: list[tuple[int, int]]
    references: list[str]
    bare: bool


def name_score(name: str) -> float:
    """How sensitive a target name is: the best of its parts and of its pairs of parts; 0 for names about secrets."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    single = max(SENSITIVE.get(w, 0.0) for w in words)
    return max([single, *(SENSITIVE_PAIRS.get(pair, 0.0) for pair in zip(words, words[1:], strict=False))])


def literal_score(value: str) -> float:
    """How likely a literal is a secret, from 0 to 1: its length, kinds of characters and entropy; 0 for placeholders and phrases."""
    if len(value) < 8 or len(value) > LONGEST or PLACEHOLDER.search(value) or re.search(r"\s|\$\{|\{\{|://[^:@/]*(/|$)", value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if kinds < 2 or not re.search(r"[0-9]", value) and kinds < 3:
        return 0.0
    counts = Counter(value).values()
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    return min(1.0, bits / 3.2)


def bindings(text: str) -> list[Binding]:
    """Name-literal and name-name pairs in the order of the text, from assignments, mappings, attributes and setter calls."""
    made = []
    for pattern in (STATEMENT, CALL):
        for m in pattern.finditer(text):
            literals, references, bare = [], [], False
            term = m
            while term:
                if term["quoted"] is not None:
                    a, b = term.span("quoted")
                    edge = 3 if b - a >= 6 and text[a] * 3 == text[a : a + 3] else 1
                    inner = text[a + edge : b - edge]
                    if inner.startswith("$") and (found := REFERENCE.fullmatch(inner)):
                        references.append(found[1])
                    elif inner:
                        literals.append((a + edge, b - edge))
                else:
                    word = term["bare"].rstrip(".:")
                    if found := REFERENCE.fullmatch(word):
                        references.append(found[1])
                    if term is m and _BARE_LITERAL.fullmatch(word):
                        literals.append((term.start("bare"), term.start("bare") + len(word)))
                        bare = True
                term = FURTHER.match(text, term.end("value"))
            if literals or references:
                made.append(Binding(m["name"], m.start("name"), literals, references, bare and len(references) == 1))
    made.sort(key=lambda b: b.at)
    return made


def flows(found: list[Binding]) -> Iterator[tuple[Binding, set[str]]]:
    """Each binding that holds literals, with all names that its value reaches.

    A reference means the last binding of that name before it, or the first one after it where there is none before.
    """
    places: dict[str, list[int]] = {}
    for i, b in enumerate(found):
        places.setdefault(b.name, []).append(i)
    readers: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        for name in b.references:
            known = places.get(name) or places.get(name.rsplit(".", 1)[-1]) or []
            at = bisect(known, i - 1)
            source = known[at - 1] if at else next((k for k in known[:2] if k > i), None)
            if source is not None:
                readers.setdefault(source, []).append(i)
                if b.bare:
                    b.literals = []
    for i, b in enumerate(found):
        if b.literals:
            seen, waiting = {i}, [i]
            while waiting:
                fresh = [r for r in readers.get(waiting.pop(), ()) if r not in seen]
                seen.update(fresh)
                waiting += fresh
            yield b, {found[k].name for k in seen}


def base_spans(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, word) of the base patterns."""
    low = text.lower()
    out: list[tuple[str, int, int, str | None]] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    return out


def scan_text(text: str, least: float = 0.6) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, name, score) of the secrets in ``text`` by start and kind; places are code points.

    Base matches have score 1 and, for assignments, their word. The literals of a value are added if the most sensitive
    name that the value reaches, times the score of the literals together, is ``least`` or more, unless a base match
    covers them.
    """
    out = [(*span, 1.0) for span in base_spans(text)]
    if _HINTS.search(text):
        covered = Cover([(a, b) for _, a, b, _, _ in out])
        added: dict[tuple[int, int], tuple[str, float]] = {}
        found = bindings(text)
        for b, names in flows(found) if any(map(name_score, {b.name for b in found})) else ():
            name = max(sorted(names), key=name_score)
            if not (weight := name_score(name)):
                continue
            score = weight * literal_score("".join(text[start:end] for start, end in b.literals))
            for span in b.literals:
                if score >= least and score > added.get(span, ("", 0.0))[1] and not covered.holds(*span):
                    added[span] = name, score
        out += [("literal", start, end, name, score) for (start, end), (name, score) in added.items()]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Cover:
    """Spans by start, to ask whether one of them holds another span."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans.sort()
        self.starts = [a for a, _ in spans]
        self.ends = list(itertools.accumulate((b for _, b in spans), max))

    def holds(self, start: int, end: int) -> bool:
        at = bisect(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end


FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.6) -> DataFrame:
    """One row per input row: id and ``found``, an array of (kind, start, end, name, score) by start and kind.

    Kinds: ``assign``, ``access`` and ``hex`` are leftmost non-overlapping matches of the base patterns, each kind by
    itself; ``literal`` is a literal whose target name, or a name its value is passed on to, is sensitive. Places are
    code points, ``end`` exclusive. A null or empty text has none; repeated rows give repeated results; a null id stays
    null; other columns are not read. Whole texts are read, one at a time.
    """
    docs = docs.select(id_column, text_column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in parts(frames):
            found = [[dict(zip(FOUND.names, s, strict=True)) for s in scan_text(t or "", least)] for t in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found, pa.list_(FOUND))], names=[id_column, "found"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_column}` {kind}, found array<struct<kind: string, start: long, end: long, name: string, score: double>>")
