"""Operators that give back the caller's rows keep columns of any name and type."""

from strideframe.llm.jaccard_join import one_of_each
from strideframe.llm.line_dedup import dedup_lines
from strideframe.llm.secret_scan import masked

NAMES = ["removed", "secrets", "__key", "__own", "kept", "order", "row_key", "removed_lines_", "a.b"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES) + ", m map<string,int>"


def rows(texts):
    return [(i, t, *[f"{n}{i}" for n in NAMES], {"k": i}) for i, t in enumerate(texts)]


def others(r):
    return tuple(r[n] for n in NAMES) + (r["m"]["k"],)


def own(i):
    return tuple(f"{n}{i}" for n in NAMES) + (i,)


def test_line_dedup(spark):
    twice = "one line that repeats here\nand the line that follows it"
    got = dedup_lines(spark.createDataFrame(rows([twice + "\nfirst", "second\n" + twice, None]), SCHEMA)).orderBy("doc_id").collect()
    assert [others(r) for r in got] == [own(0), own(1), own(2)]
    assert [r.text for r in got] == [twice + "\nfirst", "second", None]


def test_masking(spark):
    got = masked(spark.createDataFrame(rows(["password = hunter2hunter2 end", None, ""]), SCHEMA)).orderBy("doc_id").collect()
    assert [others(r) for r in got] == [own(0), own(1), own(2)] and got[0].text == "[ASSIGN] end"


def test_one_of_each(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame(rows([text, text + " more", "another text altogether with words", None]) + [(0, text, *own(9)[:-1], {"k": 9})], SCHEMA)
    got = one_of_each(df).collect()
    assert sorted(r.doc_id for r in got) == [0, 2, 3]
    assert {r.doc_id: others(r) for r in got} == {0: own(0), 2: own(2), 3: own(3)}
