import random

from corpus import frame, sentence
from panelcast.llm.line_windows import dedup_lines


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        filled = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(x for _, x in filled[k : k + 3])
            if window in seen:
                gone |= set(range(filled[k][0], filled[k + 2][0] + 1))
            seen.add(window)
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [sentence(rng, 4) for _ in range(12)] + ["", "  "]
    shared = [sentence(rng, 5) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 25))]
        if i % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = shared
        rows.append((i, "\n".join(lines)))
    made = dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.text, r["__lines"].n_lines, r["__lines"].n_removed) for r in made} == brute(rows)
    assert made[0].id == 1 and made[0]["_lines"] == "x"


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc"), (5, "x\na\n\nb\nc\ny"), (5, "x\na\n\nb\nc\ny"), (None, "a\nb\nc"), (8, long), (9, long + "\nmore")]
    made = sorted((r.doc_id or -1, r.text) for r in dedup_lines(frame(spark, rows, extra=""), 3).select("doc_id", "text").collect() if r.text is not None)
    # a null id sorts first and keeps the lines
    assert made == [(-1, "a\nb\nc"), (2, ""), (3, "a\nb"), (4, ""), (5, "x\ny"), (5, "x\ny"), (8, long), (9, "more")]
    assert dedup_lines(frame(spark, [])).collect() == []


def test_repeats_within_a_document(spark):
    rows = [(1, "a\nb\nc\na\nb\nc\nd"), (2, "q\nq\nq\nq\nq")]
    made = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert made == {i: t for i, (t, *_) in brute(rows).items()}
