import re

import pytest

from strideframe.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, words string, keys string"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("position_bits", [20, 3])
def test_measures_match_brute_force(spark, monkeypatch, position_bits):
    monkeypatch.setattr(Q, "POSITION_BITS", position_bits)  # 3: almost every text takes the way without hashes
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 90, "a b c d\na b c d\n\n \na b c", "é ü\x0bö\x0c$ #x\r\n<z>", "a a a a b a a a"]
    texts += [" ".join(f"w{(i * i) % 17}" for i in range(200)), "the\n" * 60]
    rows = [(i, t, "x", None) for i, t in enumerate([*texts, *texts[-2:]])]
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)


def test_no_python_in_the_plan_and_empty_table(spark, capsys):
    df = Q.op6_rules(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    df.explain()
    assert "Python" not in capsys.readouterr().out
