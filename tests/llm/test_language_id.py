import zlib

import numpy as np

from strideframe.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the cat sat on that mat while they think".split(), "de": "der hund und die katze schläft über".split(), "fr": "le chat était où l'été français".split()}


def made(n):
    rng = np.random.default_rng(1)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], 30)), langs[i % 3], None) for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    rows = made(300) + [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "123 !?", None, ""), (1003, WORDS["de"][0] * 200_000, None, "")]
    rows += [(None, "the cat", "en", ""), (5, "the cat", "en", "")]
    got = L.op5_naive_bayes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == list(WORDS)[r.doc_id % 3] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_table_and_no_labels(spark):
    assert L.op5_naive_bayes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = L.op5_naive_bayes(spark.createDataFrame([(1, "the", None, "")], SCHEMA)).collect()
    assert got[0].lang_pred == "und"


def test_segments_do_not_change_sums():
    weights = np.vstack([np.random.default_rng(0).normal(size=(L.BUCKETS, 2)), np.zeros((1, 2))])
    texts = ["abc défg " * 50, "", None, "x"]
    whole = L._sums(texts, weights)[0]
    old, L.SEGMENT = L.SEGMENT, 7
    try:
        assert np.allclose(L._sums(texts, weights)[0], whole)
    finally:
        L.SEGMENT = old


def brute_force(rows):
    """doc_id -> (language, probability), one n-gram at a time."""
    import math
    import zlib
    from collections import Counter

    mask = (1 << 64) - 1

    def bucket(gram):
        x = sum(c << 21 * k for k, c in enumerate(gram)) + len(gram) & mask
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & mask
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & mask
        return (x ^ x >> 33) % L.BUCKETS

    def grams(text):
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
        return [bucket(points[i : i + n]) for i in range(len(points) - 2) for n in (1, 2, 3)]

    counts, docs = {}, Counter()
    for i, text, lang, *_ in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams(text))
            docs[lang] += 1
    out = {}
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
            continue
        value = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + L.SMOOTHING * L.BUCKETS
            value[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][b] + L.SMOOTHING) / total) for b in grams(text))
        best = max(value, key=value.get)
        out[i] = (best, 1 / sum(math.exp(v - value[best]) for v in value.values()))
    return out


def test_predictions_match_brute_force(spark):
    import random

    rng = random.Random(3)
    words = {"xx": ["une", "été", "deux mots", "Où"], "yy": ["ein", "über", "zwei Worte", "Größe"], "zz": ["one", "two", "Three words"]}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        pool = words[lang] if rng.random() < 0.7 else sum(words.values(), [])
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))), lang if i % 9 else None))
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "12 34 !", "zz"), (103, "e", None), (104, "Größe " * 3000, "yy")]
    got = L.op5_naive_bayes(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9
