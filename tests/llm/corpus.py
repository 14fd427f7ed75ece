"""Small corpora for brute-force comparison."""

import random
import re

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim nor pul wek zas".split()]
EXTRA = "id long, key long, digest string, n int, bits long, row string, gone string, window string, spans string, bucket string, _lines string, _language string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, columns="doc_id long, text string", extra=EXTRA):
    """Rows with columns whose names clash with those inside the operators."""
    extras = [x.strip().rsplit(" ", 1)[1] for x in extra.split(",") if x]
    more = tuple(1 if t in ("long", "int") else "x" for t in extras)
    return spark.createDataFrame([tuple(r) + more for r in rows], columns + (", " + extra if extra else ""))


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def grams(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    size = min(width, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups(nodes, links):
    """The smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}
