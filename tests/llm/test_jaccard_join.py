import random

import numpy as np
import pytest

from strideframe.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, key string, component string"


def shingles(text):
    words = (text or "").encode().translate(J._LOWERED).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, row in enumerate(rows):
        names.setdefault(find(i), []).append(row[0])
    return sorted((row[0], len(s), min(names[find(i)])) for i, (row, s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 1)
    return words or ["x"]


def made(seed, n):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "A b\tc\x0bd", "a b c d e", "é É"]
    while len(texts) < n:
        size = rng.choice([5, 6, 7, 8, 9, 11, 14, 20, 30, 45, 80, 150, 300])
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.choice([1, 2, 3, 5, 15])):
            base = base if rng.random() < 0.5 else edited(rng, base, 1)
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, len(base) // 40, len(base) // 25]))))
    rows = [(i, t, "k", None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small_group,tile", [(1, 8, 2048), (2, 2, 4)])
def test_components_match_brute_force(spark, monkeypatch, seed, small_group, tile):
    monkeypatch.setattr(J, "SMALL_GROUP", small_group)
    monkeypatch.setattr(J, "TILE", tile)
    rows = made(seed, 500)
    got = J.op10_universe_partition(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute_force(rows)


def candidate_pairs(texts, hot=()):
    parts, at = [], 0
    for _, sizes, hashes in J.shingle_sets(texts):
        keys, _ = J.class_keys(hashes, sizes)
        doc, sig, flags = J.signatures(hashes, sizes, np.sort(np.array(hot, np.uint64)))
        parts.append((keys, doc, sig, flags))
    keys, doc, sig, flags = (np.concatenate(x) for x in zip(*parts))
    found = set()
    for block in J.packed_blocks(keys, doc, sig, flags, 3).groupby("bucket"):
        pairs, _ = J.bucket_candidates(block[1]["keys"], block[1]["counts"], block[1]["entries"])
        found |= {tuple(sorted(p)) for p in pairs.tolist()}
    return keys, found


@pytest.mark.parametrize("size", [3, 4, 5, 7, 10, 17, 40, 130, 600])
def test_pairs_at_the_threshold_are_candidates(size):
    """Sets of `size` shingles against partners exactly as far as allowed, from one side and from both."""
    rng = random.Random(size)
    for trial in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
        room = size // 4
        cut = rng.randint(0, room)
        other = words[cut:] if trial % 2 else words[: len(words) - cut]
        grow = 0  # words more at one end, as many as keep the similarity at 3/4
        while 4 * (size - cut) >= 3 * (size + grow + 1):
            grow += 1
        other = other + [f"n{rng.randrange(10**9)}" for _ in range(grow)] if trial % 2 == 0 or cut == 0 else other + [f"n{i}" for i in range(grow)]
        texts = [" ".join(words), " ".join(other)]
        a, b = map(shingles, texts)
        if a == b or 100 * len(a & b) < 75 * len(a | b):
            continue
        hot = [int(x) for _, _, h in J.shingle_sets(texts[:1]) for x in h[:: rng.choice([1, 2, 5])]] if trial % 3 == 0 else ()
        keys, found = candidate_pairs(texts, hot)
        assert tuple(sorted(keys.tolist())) in found


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (5, 40), (300, 290), (1000, 1300)):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64)
        b[: min(n, m) // 2] = a[: min(n, m) // 2]
        assert J.sketch_distance(J.sketch(a), J.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
        assert J.sketch_distance(J.sketch(a), J.sketch(a)) == 0


def test_edges(spark):
    assert J.op10_universe_partition(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "", ""), (None, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (8, long, "", ""), (9, long + " end", "", "")]
    got = J.op10_universe_partition(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(
        map(str, spark.createDataFrame([(1, 0, 1), (None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 59_996, 8), (9, 59_997, 8)], "doc_id long, n_shingles long, component_id long").collect())
    )
