import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from strideframe.llm import sentencepiece_bpe as B

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_pieces string"
TEXTS = ["", " ", "a", " a  b\n c\t", "Grüße 日本 é😀 <s> </s> <0x41>", "x" * 700, "  many   spaces     here ", "the quick brown fox " * 50]


def keys(n, seed=1):
    return [B.text_key(i, seed) for i in range(n)]


def random_texts(n=60):
    rng = random.Random(3)
    return ["".join(rng.choice("aeinrst  thé\nß日▁") for _ in range(rng.randint(1, 120))) for _ in range(n)]


def test_without_dropout_it_is_the_library():
    sp, m = sentencepiece.SentencePieceProcessor(model_file=PATH), B.model(PATH)
    texts = TEXTS + [t.replace("▁", "") or "x" for t in random_texts()]
    assert [x.tolist() for x in B.encode_texts(m, texts, keys(len(texts)), 0.0)] == sp.encode(texts)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_varies_and_decodes_losslessly(rate):
    m, texts = B.model(PATH), TEXTS + random_texts()
    first = B.encode_texts(m, texts, keys(len(texts)), rate)
    assert [B.decode_ids(m, x.tolist()) for x in first] == texts
    again, other = B.encode_texts(m, texts, keys(len(texts)), rate), B.encode_texts(m, texts, keys(len(texts), 2), rate)
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    assert rate == 1.0 or any(not np.array_equal(a, b) for a, b in zip(first, other))
    assert sum(map(len, first)) > sum(map(len, B.encode_texts(m, texts, keys(len(texts)), 0.0)))


def test_words_in_step_match_the_heap(monkeypatch):
    m, texts = B.model(PATH), TEXTS + random_texts()
    fast = B.encode_texts(m, texts, keys(len(texts)), 0.2)
    monkeypatch.setattr(B, "LONG_WORD", 0)
    assert all(np.array_equal(a, b) for a, b in zip(fast, B.encode_texts(m, texts, keys(len(texts)), 0.2)))
    monkeypatch.setattr(B, "BLOCK", 10)
    assert all(np.array_equal(a, b) for a, b in zip(fast, B.encode_texts(m, texts, keys(len(texts)), 0.2)))


def test_query_round_trips(spark):
    rows = [(i, t, "x", None) for i, t in enumerate([None, *TEXTS, "long text " * 20_000])] + [(None, "no id", "", ""), (2, " ", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = B.op4_merge_dropout(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    decoded = sorted(map(str, B.decode(B.encode(docs, PATH), PATH).collect()))
    assert decoded == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert B.op4_merge_dropout(spark.createDataFrame([], SCHEMA), PATH).count() == 0
