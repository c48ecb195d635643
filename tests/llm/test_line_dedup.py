import hashlib
import random

import pytest

from strideframe.llm import line_dedup as D

SCHEMA = "doc_id long, text string, row_key string, lines string"


def run(spark, rows):
    got = D.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    return got


def test_passages_stay_once_and_every_line_survives(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 12)))
    passage = [line() for _ in range(9)]
    rows = []
    for i in range(120):
        lines = [line() for _ in range(rng.randint(1, 30))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines), "k", None))
    got = {r.doc_id: r for r in run(spark, rows)}
    kept_in = [sum(x in got[i].text.split("\n") for i in range(0, 120, 3)) for x in passage]
    assert kept_in == [1] * 9
    for i, text, *_ in rows:
        old, new = text.split("\n"), got[i].text.split("\n")
        gone = set(got[i].removed_lines or [])
        assert new == [x for k, x in enumerate(old) if k not in gone] or (new == [""] and len(gone) == len(old))
        assert i % 3 == 0 or not gone
        assert all(old[k] in passage for k in gone)
    everything = {x for r in got.values() for x in r.text.split("\n")}
    assert {x for _, t, *_ in rows for x in t.split("\n")} <= everything


def test_brute_force_of_entries(spark):
    """Removed lines are exactly those in an entry whose bytes occur at an earlier (doc_id, start)."""
    rng = random.Random(9)
    pool = [f"line number {i} of a small pool of lines" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))), "k", None) for i in range(80)]
    got = {r.doc_id: set(r.removed_lines or []) for r in run(spark, rows)}
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id as row_key", "doc_id", "text")
    found, texts = {}, {i: t.split("\n") for i, t, *_ in rows}
    for r in D.entries(docs).collect():
        found.setdefault("\n".join(texts[r.doc_id][r.start : r.start + r.n]), set()).add((r.doc_id, r.start, r.n))
    want = {i: set() for i in texts}
    for places in found.values():
        for doc, start, n in sorted(places)[1:]:
            want[doc] |= set(range(start, start + n))
    assert got == want


def test_edges(spark):
    same = "the first line of a passage that repeats\nthe second line of the passage that repeats"
    rows = [(1, None, "", ""), (2, "", "", ""), (3, same, "", ""), (3, same, "", ""), (4, same, "", ""), (None, "x\ny", "", ""), (5, "\n" * 50, "", ""), (6, "a line\n" * 40_000, "", "")]
    got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [same, same] and by[4] == [""] and by[5] == ["\n" * 50]
    assert len(by[6][0].split("\n")) < 200
    assert D.op7_line_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
    row = D.op7_line_chunks(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 4").first()
    assert row.n_removed_lines == 2 and row.text_sha256 == hashlib.sha256(b"").hexdigest()


def runs_that_repeat(texts, least):
    """By doc_id the numbers of the lines in a run of 2 to 16 lines and `least` bytes that stands somewhere at an earlier (doc_id, place)."""
    seen, want = set(), {i: set() for i in texts}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for start in range(len(lines)):
            for n in range(2, min(16, len(lines) - start) + 1):
                run = tuple(lines[start : start + n])
                if sum(len(x.encode()) for x in run) >= least:
                    if run in seen:
                        want[i] |= set(range(start, start + n))
                    seen.add(run)
    return want


@pytest.mark.parametrize("least", [1, 48])
def test_every_repeated_run_goes_wherever_boundaries_fall(spark, least):
    rng = random.Random(21)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9)))
    passages = [[fresh() for _ in range(rng.randint(2, 6))] for _ in range(25)]
    pool = ["", "ab", "a short one", "line of twenty bytes", "a line that is over twenty-four bytes"]
    texts = {}
    for i in range(150):
        lines = [fresh() for _ in range(rng.randint(2, 9))]
        if i % 3 == 2:
            lines = [rng.choice(pool) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(lines))
        lines[at:at] = rng.choice(passages)
        texts[i] = "\n".join(lines)
    docs = spark.createDataFrame([(i, t, "k", None) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: set(r.removed_lines or []) for r in D.dedup_lines(docs, least_bytes=least).collect()}
    assert got == runs_that_repeat(texts, least)


def test_boundaries_do_not_shift(spark):
    """Chunks of a passage are the same wherever it stands, but for the first lines and those at the cut after MOST_LINES."""
    rng = random.Random(5)
    lines = [f"line {rng.randrange(10**9)}" for _ in range(300)]
    docs = spark.createDataFrame([("\n".join(lines),), ("\n".join(lines[3:]),), ("\n".join(["new"] * 5 + lines),)], "text string")
    hashes = docs.selectExpr("transform(split(text, '\n'), x -> pmod(xxhash64(x), 2147483647)) AS h")
    cuts = [set(r.c) for r in hashes.select(D._cuts(hashes.h).alias("c")).collect()]
    assert 40 < len(cuts[0]) < 120
    for shift, own in ((-3, cuts[1]), (5, cuts[2])):
        assert {c + shift for c in cuts[0] if c >= 6} == {c for c in own if c >= 6 + shift}


def test_long_lines_go_by_themselves(spark):
    words = lambda n, seed: " ".join(f"w{random.Random(seed + k).randrange(10**6)}" for k in range(n))
    long, short = words(60, 100), words(49, 900)
    texts = {1: f"before one\n{long}\nafter one", 2: f"before two\n{long}\nafter two", 3: long, 4: f"before four\n{short}\nafter four", 5: short, 6: f"{short}\nafter six", 7: words(60, 500)}
    got = {r.doc_id: r for r in run(spark, [(i, t, "k", None) for i, t in texts.items()])}
    assert {i: r.removed_lines for i, r in got.items()} == {1: None, 2: [1], 3: [0], 4: None, 5: None, 6: None, 7: None}
    assert got[2].text == "before two\nafter two" and got[3].text == "" and got[7].text == texts[7]
