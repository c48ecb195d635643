import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strideframe.llm import packing as P

SCHEMA = "doc_id long, text string, length string, rank string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fill_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        room = rng.randint(0, 60)
        items = list(counts.elements())
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        used = P.fill(dict(counts), room)
        assert sum(k * n for k, n in used.items()) == best and all(counts[k] >= n for k, n in used.items())


def test_plan_uses_every_length_once():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 1023) for _ in range(5000))
    lines = P.plan(dict(counts))
    assert sum((Counter({k: n * t for k, n in used.items()}) for t, used in lines), Counter()) == counts
    windows = sum(t for t, _ in lines)
    assert windows <= 1.005 * sum(k * n for k, n in counts.items()) / 1024 + 1


@pytest.mark.parametrize("n", [0, 40])
def test_pieces_tile_documents_and_sequences(spark, n):
    texts = [None, "", "a", "word " * 1023, "word " * 5000, "Grüße <|endoftext|> 日本\n\n x", "one two three"]
    rows = [(i, texts[i % 7], "", None) for i in range(n)]
    rows += rows[-1:]
    got = P.op2_bin_slack(spark.createDataFrame(rows, SCHEMA), RANKS).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        times = [x[0] for x in rows].count(i)
        assert sum(n for _, n in docs[i]) == times * len(own)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))


def test_queries_give_special_tokens_their_ids(spark, tmp_path):
    import corpus_pipeline
    from strideframe.llm import queries

    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b <|endoftext|", "x" * 9 + "<|endoftext|>'s  \n", "plain  text \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert ids[0] == [31373, 220, 50256, 995, 0]
    want = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    for got in (queries.op2_minimum_bin_slack(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got.collect()} == want


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", "x \t" + " " * 1_000_000, "a" * 300_000, "7" * 300_000, "<|endoftext|>" + " " * 150_000 + "end"])
def test_long_runs_equal_the_library(text):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.encoder(RANKS, P.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))(text) == whole.encode(text, add_special_tokens=False).ids
    whole.encode_special_tokens = True
    assert P.encoder(RANKS)(text) == whole.encode(text, add_special_tokens=False).ids
