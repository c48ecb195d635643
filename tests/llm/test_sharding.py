import hashlib
import math
import zlib

import pytest

from strideframe.llm import common as C
from strideframe.llm import sharding as S
from strideframe.llm.sharding import hilbert_shards, hilbert_table

SCHEMA = "doc_id long, text string, lang string, source string, shard string"


def test_consecutive_cells_are_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        cells = {r.curve: [r.cell >> (bits * d) & ((1 << bits) - 1) for d in range(dims)] for r in hilbert_table(spark, dims, bits).collect()}
        assert sorted(cells) == list(range(1 << (dims * bits)))
        assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(len(cells) - 1))


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_rows_law_and_slots(spark, n):
    texts = [None, "", "same", "same", "x" * 3000]
    rows = [(i if i % 11 else None, texts[i % 7] if i % 7 < 5 else f"text {i}", "en" if i % 3 else None, f"s{i % 5}", "x") for i in range(n)]
    got = hilbert_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    want = sorted((t or "").encode() for _, t, *_ in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t) + 8, zlib.crc32(t)) for t in want)


def brute_force(spark, rows, shards):
    """doc_id -> (curve, shard, slot), one row at a time."""
    curve = {r.cell: r.curve for r in hilbert_table(spark, 3).collect()}
    line = lambda x: 0 if x is None else zlib.crc32(x.encode()) % 16
    groups = {}
    for i, text, lang, source, *_ in rows:
        size = len((text or "").encode()) + 8
        groups.setdefault((text or "").encode(), []).append((i, line(lang), line(source), max(0, min(15, math.floor((math.log2(size) - 6) * 1.5)))))
    order = []
    for text, members in groups.items():
        _, a, b, c = min(members)
        order += [(curve[a + 16 * b + 256 * c], zlib.crc32(text), hashlib.sha256(text).digest(), m[0]) for m in members]
    order.sort()
    shard = [k * shards // len(order) for k in range(len(order))]
    return {x[3]: (x[0], shard[k], k - shard.index(shard[k])) for k, x in enumerate(order)}


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_every_row_is_where_brute_force_puts_it(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(S, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(S, "HOT_PART", 1)  # no group has salts, so the order within a group is that of the ids
    monkeypatch.setattr(C, "HOT_PART", 1)
    rows = [(i, ("same", "x" * 3000, None, "", "y" * 200_000)[i % 7] if i % 7 < 5 else f"text {i % 150}", ("en", "de", None)[i % 3], f"s{i % 5}", "x") for i in range(700)]
    got = {r.doc_id: (r.curve, r.shard, r.slot) for r in S.hilbert_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()}
    assert got == brute_force(spark, rows, 24)


def test_copies_follow_each_other(spark):
    rows = [(i, ("copy", f"text {i}", "twin" if i < 300 else f"pair {i // 6}")[i % 3], ("en", "de")[i % 2], f"s{i % 7}", None) for i in range(900)]
    texts = {i: t for i, t, *_ in rows}
    got = sorted((r.shard, r.slot, texts[r.doc_id]) for r in S.hilbert_shards(spark.createDataFrame(rows, SCHEMA), 9).collect())
    runs = [t for k, (_, _, t) in enumerate(got) if not k or got[k - 1][2] != t]
    assert len(runs) == len(set(texts.values()))
