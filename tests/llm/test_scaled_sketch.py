import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideframe.llm.scaled_sketch import BITS, SCALED, containment, decoded, encoded, likeness, merged, op11_sketches, reduced, sketches

DOCS = "doc_id long, text string, lang string, tie int, h string, part string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**BITS - 1), max_size=60), st.sets(st.integers(0, 2**BITS - 1), max_size=60), st.integers(1, 40))
def test_sketches_merge_like_their_sets(a, b, scaled):
    def kept(s):
        return reduced(np.array(sorted(s), np.uint64), scaled)

    limit = -(-(2**BITS) // scaled)
    assert kept(a).tolist() == (sorted(x for x in a if x < limit) or sorted(a)[:1])
    assert merged(kept(a), kept(b), scaled).tolist() == kept(a | b).tolist()
    assert decoded(encoded(kept(a))).tolist() == kept(a).tolist()


def test_containment_is_that_of_the_sets():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 60_000)]
    large, small = " ".join(words), " ".join(words[10_000:13_000] + [f"v{i}" for i in range(3_000)])
    a, b = sketches([large, small])
    inner, outer = shingles(small), shingles(large)
    assert abs(len(a) - len(outer) / SCALED) < 5 * (len(outer) / SCALED) ** 0.5
    assert abs(containment(b, a) - len(inner & outer) / len(inner)) < 0.08 and likeness(a, b) == containment(b, a)
    both = merged(a, b)
    assert containment(a, both) == containment(b, both) == 1


def brute(docs):
    held = [(d, t or "") for d, t, *_ in docs]
    marks = dict(zip({t for _, t in held}, sketches(list({t for _, t in held}))))
    out = []
    for (d, t), (_, f) in zip(held, held[1:] + held[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + f[:half]
        (changed,) = sketches([new])
        a, c = set(marks[t].tolist()), set(marks[f].tolist())
        e = set(changed.tolist())
        near = [1.0 if x == a else len(x & a) / max(1, min(len(x), len(a))) for x in (e, c)]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), encoded(marks[t]), encoded(changed), *near))
    return sorted(out, key=repr)


def collected(df):
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_query_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, n)) for n in rng.integers(0, 200, 60)] + ["", None, "é　ü𝄞 x", "a", "ab c d e", "A B C D E F", "word " * 30_000]
    docs = [(1000 - 3 * i, t, "en", 1, "h", "p") for i, t in enumerate(texts)]
    want = brute(docs)
    df = spark.createDataFrame(docs, DOCS).orderBy(F.rand(1)).repartition(7)
    assert collected(op11_sketches(df)) == want
    with_null = docs + [(None, "the last of all rows here", None, None, None, None)]
    assert collected(op11_sketches(spark.createDataFrame(with_null, DOCS).repartition(3))) == brute(with_null)


def test_repeated_rows_follow_each_other(spark):
    docs = [(9, "the first of all texts here", "", 0, "", "")] + [(5, "same text in every one of them", "", 0, "", "")] * 40 + [(2, "a last text with some words", "", 0, "", "")]
    assert collected(op11_sketches(spark.createDataFrame(docs, DOCS).repartition(5))) == brute(docs)


def test_small_tables(spark):
    assert op11_sketches(spark.createDataFrame([], DOCS)).count() == 0
    (row,) = op11_sketches(spark.createDataFrame([(1, "one two", "", 0, "", "")], DOCS)).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"one one").hexdigest()


def test_edited_and_next_documents_differ_in_likeness(spark):
    rows = op11_sketches(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 > 0.1 > sum(r.near_next for r in rows) / len(rows)
