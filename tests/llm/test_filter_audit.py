import itertools
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm.filter_audit import audit, op12_audit, plain_changes

DOCS = "doc_id long, text string, lang string, mask string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_plain_changes_visit_every_order_by_swaps_of_neighbours():
    for n in range(1, 6):
        seen = list(plain_changes(n))
        assert sorted(o for o, _ in seen) == sorted(itertools.permutations(range(n)))
        for (a, _), (b, p) in zip(seen, seen[1:]):
            assert [i for i in range(n) if a[i] != b[i]] == [p, p + 1]


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(1, 9), max_size=32))
def test_updated_steps_equal_steps_counted_anew(counts):
    masks, n = np.array(list(counts), int), np.array([[c, c // 2, c // 3] for c in counts.values()], np.int64).reshape(-1, 3)
    walk, shapley, _ = audit(masks, n)
    sums = [0] * 5
    for order, steps in walk:
        left = dict(counts)
        for f, (kept, removed, *_rest) in zip(order, steps.tolist()):
            gone = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if m not in gone}
            assert (kept, removed) == (sum(left.values()), sum(gone.values()))
            sums[f] += removed
    assert sums == shapley.tolist()


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    rows = []
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum(c in string.ascii_uppercase for c in t) > 10 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": d is not None and any((o or "") == t and i is not None and i < d for i, o, _ in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        found = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                late = [r for r in own if f in r[1] and set(order[:k]) & r[1]]
                left = [r for r in left if f not in r[1]]
                unique = sum(r[1] == {f} for r in own)
                found.append((part, "".join(order), k + 1, len(left), len(gone), len(late), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        shapley = {f: sum(x[4] for x in found if x[1][x[2] - 1] == f) for f in "ABCDE"}
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in found}
    return out


def test_whole_query_equals_brute_force_with_nulls_ties_repeats_and_clashing_columns(spark):
    long_text = " ".join(f"word{i}" for i in range(120))
    docs = [
        (1, long_text, "en"), (2, long_text, "en"), (2, long_text, "de"), (1, long_text, None), (3, None, "en"), (4, "", "en"), (None, "", "fr"), (None, None, None),
        (5, "SHOUT LOUD", "de"), (6, "a # b", "en"), (7, "x " * 150, ""), (8, "Word " + long_text, "fr"), (9, long_text + " |", "fr"), (9, "tab\tand\x0bspace one", "fr"), (10, "y" * 300_000 + " $", "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 0, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    got = op12_audit(spark.createDataFrame([(*d, "kept") for d in docs], DOCS), spark.createDataFrame([(*x, "t") for x in labels], LABELS)).collect()
    assert {tuple(r) for r in got} == brute(docs, labels) and len(got) == 600 * 4


def test_empty_tables(spark):
    assert op12_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = op12_audit(spark.createDataFrame([(1, "a", "en", "")], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and one.where("step = 5").agg({"kept": "sum"}).first()[0] == 0
