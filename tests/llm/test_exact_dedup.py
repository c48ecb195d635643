import hashlib

import pytest

from strideframe.llm.exact_dedup import exact_groups

SCHEMA = "doc_id long, text string, digest string, run string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("parts", [1, 9, 20])
def test_groups_match_brute_force(spark, keep, pick, parts):
    texts = [None, "", "Copy", "cOPY", "Éa", "éa", "long " * 4000]
    rows = [(i, texts[i % 9] if i % 9 < 7 else f"t{i}", "x", None) for i in range(300)]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(parts), keep).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = {(i, pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_empty_and_null_ids(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = exact_groups(spark.createDataFrame([(None, "a", "", ""), (3, "a", "", ""), (3, "a", "", "")], SCHEMA)).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(3, 3)}


def test_split_files_make_no_double_runs(spark, monkeypatch):
    small = {"parquet.block.size": "20000", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000", "parquet.page.size": "4000"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = [(i, f"text number {i % 2000}", "x", None) for i in range(6000)]
        got = exact_groups(spark.createDataFrame(rows, SCHEMA).coalesce(1), "largest").collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 4000 + i % 2000, 3) for i in range(6000)}
