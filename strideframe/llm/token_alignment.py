"""Cross-tokenizer alignment by joins: which tokens of two tokenizers cover the same bytes of a text, and how often a pair of them meets in the corpus.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE. A single space or line feed between two characters that are no white space starts a token in
both, and a line feed there ends one: A's pattern breaks there, and no piece of B has a space behind another character or a line feed (checked on the
vocabulary; if one has, texts stay whole). So a text behind one space is a row of chunks that start there, each tokenized as if alone, and both tokenizers
cut at every chunk's end. Each different chunk of the corpus is aligned once and documents are put together from their chunks by joins:

1. `chunks`: the different chunks with their numbers of occurrences.
2. `tokenized`: their ids and token lengths in both tokenizers, and whether the tokens of each join to the chunk's own bytes.
3. `aligned`: tokens by posexplode, ends by windowed cumulative lengths, an equi-join of both sides on (chunk, end), the running count of ends
   that both have as the number of the group, and the two sides joined by group. A chunk that is a single token of either tokenizer has one group.
   `links` pairs the tokens of a group; in groups of more than
   SMALL_GROUP links it joins the distinct ids with their counts, so many equal tokens make few rows.
4. `assembled`: a document's chunks meet the dictionary. Chunks with more than one in HOT of all occurrences (fewer than HOT, of
   HOT_BYTES bytes at most) are broadcast and looked up where the document is; the rest, each at most one in HOT, are joined by a shuffle and
   come to the document as arrays. There the digest is made and the document's different pairs are found; a task adds up how many of its documents have a pair.
5. `pair_counts`: these sums added up; each chunk's sums over its links follow from them, and a document's from its chunks.

A document in which a chunk's tokens do not join to its bytes (a literal U+2581, say) has no tokens, as do null and empty texts. Repeated rows are
separate documents; they are numbered as they are scanned, so the documents should be a stored table. Texts are read whole, however long; one without such breaks is one chunk.
A task holds the different pairs of a document. Ties for the best partner of an id all count. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved
from .packing import encoder
from .sentencepiece_bpe import SPACE, model

BREAK = r"(?U)(?<=\S)(?=[ \n]\S)"
HOT = 1 << 20
HOT_BYTES = 32
BROADCAST_ROWS = 1_000_000
SMALL_GROUP = 64
ID_BITS = 20
PAIR_BITS = 2 * ID_BITS
SLICE = 1_000
FLUSH = 2_000_000
TOKENS = "chunk string, hot boolean, whole boolean, a array<int>, a_bytes array<int>, b array<int>, b_bytes array<int>"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
GROUPS = "array<struct<g:bigint,a:array<int>,b:array<int>>>"


def chunks(docs: DataFrame, split: bool = True):
    """The chunks of the text behind one space, each with the space or line feed that it starts with."""
    text = F.concat(F.lit(" "), "text")
    return F.split(text, BREAK) if split else F.array(text)


def splits(b_path: str) -> bool:
    """Whether no piece of B reaches over a space behind another character or has a line feed."""
    ids = model(b_path).ids
    return SPACE in ids and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids)


def _lists(lists: list, kind=pa.int32()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter((x for held in lists for x in held), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _tokenize(ranks_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import sentencepiece

        encode, sp = encoder(ranks_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(ranks_path, "rb") as lines:
            a_token = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        b_token, space = model(b_path).bytes, model(b_path).ids.get(SPACE)

        def b_ids(held):
            """B puts a space before each chunk: it stands for the chunk's own, and goes where the chunk starts with a line feed."""
            for c, ids in zip(held, sp.encode([c.removeprefix(" ") for c in held], num_threads=1)):
                if c[0] != " " and ids[0] != space:
                    raise ArithmeticError("a token reaches over the start of a line")
                yield ids if c[0] == " " else ids[1:]

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held = part.column("chunk").to_pylist()
                a, b = [encode(c) for c in held], list(b_ids(held))
                whole = []
                for c, x, y in zip(held, a, b):
                    data = c.encode()
                    whole.append(b"".join([a_token[i] for i in x]) == data == b"".join([b_token[i] for i in y]))
                a_bytes, b_bytes = [[len(a_token[i]) for i in x] for x in a], [[len(b_token[i]) for i in y] for y in b]
                columns = [part.column("chunk"), part.column("hot"), pa.array(whole, pa.bool_()), *map(_lists, (a, a_bytes, b, b_bytes))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENS.split(", ")])

    return run


def tokenized(docs: DataFrame, ranks_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """The different chunks: id, chunk, hot, whole, ids and lengths of their tokens. Equal chunks are counted before they are shuffled."""
    words = docs.where("text <> ''").select(F.explode(chunks(docs, splits(b_path))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    words = saved(words, "chunks", compression="zstd")
    total = words.agg(F.sum("n")).first()[0] or 0
    marked = words.select("chunk", ((F.col("n") * hot > total) & (F.octet_length("chunk") <= HOT_BYTES)).alias("hot"))
    out = saved(marked.mapInArrow(_tokenize(ranks_path, b_path), TOKENS).withColumn("chunk_id", F.monotonically_increasing_id()), "tokens", compression="zstd")
    drop(words)
    # numbers without holes between tasks are shorter
    task = F.shiftright("chunk_id", 33)
    counts = sorted((r["t"], r["n"]) for r in out.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per task
    starts = dict(zip([t for t, _ in counts], np.cumsum([0, *[n for _, n in counts]]).tolist()))
    first = F.broadcast(docs.sparkSession.createDataFrame(list(starts.items()), "task long, start long"))
    dense = out.join(first, task == F.col("task")).withColumn("chunk_id", F.col("start") + F.col("chunk_id").bitwiseAND((1 << 33) - 1)).drop("task", "start")
    dense.saved_at = out.saved_at
    return dense


def aligned(tokens: DataFrame) -> DataFrame:
    """Per chunk: chunk_id, chunk, hot, whole and its groups, an array of (g, a, b) with the ids of both sides in order; null if it is not whole.

    The chunks are dealt out by their id once; windows, joins and groupings by chunk follow in the same partitions. Where either side is a single
    token, its end is the only one that both have.
    """
    single = F.col("whole") & (F.least(F.size("a"), F.size("b")) == 1)
    one = F.array(F.struct(F.lit(0).cast("long").alias("g"), "a", "b")).cast(GROUPS)
    alone = tokens.where(single).select("chunk_id", "chunk", "hot", "whole", one.alias("groups"))
    tokens = tokens.where(~single).repartition("chunk_id")
    upto = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("chunk_id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    sides = {}
    for side in ("a", "b"):
        rows = tokens.where("whole").select("chunk_id", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_bytes").alias("size"))).alias("pos", "t"))
        sides[side] = rows.select("chunk_id", F.sum("t.size").over(upto).alias("end"), F.col("t.id").alias("id"))
    grouped = []
    for side, other in (("a", "b"), ("b", "a")):
        cuts = sides[other].select("chunk_id", "end", F.lit(1).alias("cut"))
        g = F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("g")
        marked = sides[side].join(cuts.hint("merge"), ["chunk_id", "end"], "left").select("chunk_id", "end", "id", g)
        ids = F.transform(F.sort_array(F.collect_list(F.struct("end", "id"))), lambda t: t["id"])
        grouped.append(marked.groupBy("chunk_id", "g").agg(ids.alias(side)))
    groups = grouped[0].join(grouped[1].hint("merge"), ["chunk_id", "g"]).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))
    return tokens.select("chunk_id", "chunk", "hot", "whole").join(groups.hint("merge"), "chunk_id", "left").unionByName(alone)


def _pair(a, b):
    return F.shiftleft(a.cast("long"), ID_BITS).bitwiseOR(b.cast("long"))


def links(chunk_groups: DataFrame) -> DataFrame:
    """Rows (chunk_id, hot, pair, k): k token occurrences of the id pair share a group; a pair has a row per group at least.

    Small groups are exploded; in large ones the different ids of each side are counted and joined.
    """
    groups = chunk_groups.select("chunk_id", "hot", F.explode("groups").alias("x")).select("chunk_id", "hot", "x.g", "x.a", "x.b")
    small = F.size("a").cast("long") * F.size("b") <= SMALL_GROUP
    plain = groups.where(small).select("chunk_id", "hot", "b", F.explode("a").alias("a")).select("chunk_id", "hot", "a", F.explode("b").alias("b"), F.lit(1).cast("long").alias("k"))
    sides = [groups.where(~small).select("chunk_id", "hot", "g", F.explode(s).alias(s)).groupBy("chunk_id", "hot", "g", s).agg(F.count(F.lit(1)).alias(f"k{s}")) for s in ("a", "b")]
    joined = sides[0].join(sides[1], ["chunk_id", "hot", "g"]).select("chunk_id", "hot", "a", "b", (F.col("ka") * F.col("kb")).alias("k"))
    return plain.unionByName(joined).select("chunk_id", "hot", _pair(F.col("a"), F.col("b")).alias("pair"), "k")


def dictionary(chunk_groups: DataFrame) -> DataFrame:
    """Per chunk: chunk, chunk_id, hot, its groups as text, null if it is not whole."""
    join = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    text = F.array_join(F.transform("groups", lambda x: F.concat(join(x["a"]), F.lit("|"), join(x["b"]))), ";")
    return chunk_groups.select("chunk_id", "chunk", "hot", text.alias("groups"))


def chunk_sums(chunk_groups: DataFrame) -> DataFrame:
    """Per chunk: chunk_id, hot and its numbers of tokens, groups and links."""
    total = lambda size: F.aggregate(F.coalesce("groups", F.array().cast(GROUPS)), F.lit(0).cast("long"), lambda n, x: n + size(x))
    sizes = {"n_a": lambda x: F.size(x["a"]), "n_b": lambda x: F.size(x["b"]), "n_groups": lambda x: F.lit(1), "n_links": lambda x: F.size(x["a"]).cast("long") * F.size(x["b"])}
    return chunk_groups.select("chunk_id", "hot", *[total(f).alias(c) for c, f in sizes.items()])


def _flat(lists) -> tuple[np.ndarray, pa.Array]:
    """The lengths of the lists (none: 0) and their elements."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def _segments(keys: np.ndarray, rows: int, bits: int) -> pa.Array:
    """A list per row of the low bits of ascending keys, whose high bits are the row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(keys >> bits, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys & ((1 << bits) - 1)))


def _pairs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of groups as text the different pairs in each group, with the places of their texts."""
    counts, groups = _flat(pc.split_pattern(texts, ";"))
    _, sides = _flat(pc.split_pattern(groups, "|"))
    ends, ids = [], []
    for side in (0, 1):
        n, own = _flat(pc.split_pattern(sides.take(pa.array(np.arange(side, len(sides), 2))), ","))
        own = np.unique(np.repeat(np.arange(len(n)), n) << ID_BITS | own.cast(pa.int64()).to_numpy(zero_copy_only=False))
        ends.append(np.bincount(own >> ID_BITS, minlength=len(groups)))
        ids.append(own & ((1 << ID_BITS) - 1))
    n = ends[0] * ends[1]
    group = np.repeat(np.arange(len(groups)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = (ids[k][(np.cumsum(ends[k]) - ends[k])[group] + at] for k, at in ((0, within // ends[1][group]), (1, within % ends[1][group])))
    return np.repeat(np.arange(len(counts)), counts)[group], a << ID_BITS | b


HELD = "row long, doc_id long, groups_sha256 string, hot_ids array<long>, hot_n array<long>, rest_ids array<long>, pair long, n long"


def _put_together(sent):
    """Batches (row, doc_id, chunks and the rest's arrays) -> a row per document, and rows (pair, n): n documents of the task have the pair."""
    names = [c.split()[0] for c in HELD.split(", ")]
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("groups_sha256", pa.string()), *[(c, pa.list_(pa.int64())) for c in ("hot_ids", "hot_n", "rest_ids")], ("pair", pa.int64()), ("n", pa.int64())])

    def batch(rows, **columns):
        return pa.RecordBatch.from_arrays([columns[c].cast(kinds.field(c).type) if c in columns else pa.nulls(rows, kinds.field(c).type) for c in names], schema=kinds)

    def run(batches):
        words, texts = pa.array(sent.value[0], pa.string()), pa.array([*sent.value[1], None], pa.string())
        at, pairs = _pairs_of(texts)
        sizes = np.bincount(at, minlength=len(texts))
        starts = np.cumsum(sizes) - sizes
        parts, held = [], 0

        def flush():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            return batch(len(found), pair=pa.array(found), n=pa.array(n))

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, SLICE):
                part = whole_batch.slice(at, SLICE)
                rows = part.num_rows
                counts, flat = _flat(part.column("chunks"))
                owner = np.repeat(np.arange(rows), counts)
                place = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                rare = place < 0
                rest_counts, rest_texts = _flat(part.column("rest_groups"))
                if rare.sum() != len(rest_texts) or (np.bincount(owner[rare], minlength=rows) != rest_counts).any():
                    raise ArithmeticError("documents were not numbered alike")
                # the rest comes in the order of the text, so it fills the gaps
                text = pc.replace_with_mask(texts.take(pa.array(place % len(texts))), pa.array(rare), rest_texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), text)
                joined = pc.binary_join(lists, ";")  # null if any part is
                whole = pc.is_valid(joined).to_numpy(zero_copy_only=False)
                digest = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, whole)]
                hot = ~rare & whole[owner]
                seen, times = np.unique(owner[hot] << 32 | place[hot], return_counts=True)
                doc, own = seen >> 32, seen & ((1 << 32) - 1)
                n = sizes[own]
                reach = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at_text, rest_pairs = _pairs_of(rest_texts)
                rest_owner = owner[rare][at_text]
                keys = np.concatenate([np.repeat(doc, n) << PAIR_BITS | pairs[reach], (rest_owner << PAIR_BITS | rest_pairs)[whole[rest_owner]]])
                parts.append(np.unique(keys) & ((1 << PAIR_BITS) - 1))
                held += len(parts[-1])
                hot_ids = _segments(seen, rows, 32)
                hot_n = pa.ListArray.from_arrays(hot_ids.offsets, pa.array(times))
                rest_ids = pc.if_else(pa.array(whole), part.column("rest_ids"), pa.scalar([], pa.list_(pa.int64())))
                yield batch(rows, row=part.column("row"), doc_id=part.column("doc_id"), groups_sha256=pa.array(digest), hot_ids=hot_ids, hot_n=hot_n, rest_ids=rest_ids)
                if held >= FLUSH:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


def assembled(docs: DataFrame, words: DataFrame, split: bool = True) -> tuple[DataFrame, list[int]]:
    """A written table: per document with a text row, doc_id, the groups' digest, its hot chunks (their places in the list that is returned too) with
    their numbers, and the ids of the others; no digest and chunks if a chunk is not whole. And rows (pair, n) of parts of the pairs' counts.

    The rarer chunks meet the dictionary first and are written, so the shuffles by chunk and by document do not take up disk together.
    """
    docs = docs.where("text <> ''").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # doc_id goes along everywhere, so that all parts scan the same columns and number the rows alike
    placed = docs.select("row", "doc_id", F.posexplode(chunks(docs, split)).alias("pos", "chunk"))
    # fewer than HOT rows of at most HOT_BYTES bytes
    hot = words.where("hot").select("chunk_id", "chunk", "groups").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((hot["chunk"].tolist(), [x if isinstance(x, str) else None for x in hot["groups"]]))
    rest = placed.join(F.broadcast(words.where("hot").select("chunk")), "chunk", "left_anti")
    rest = rest.join(words.where(~F.col("hot")).hint("merge"), "chunk").select("row", "doc_id", "pos", "chunk_id", "groups")
    found = saved(rest, "rest", compression="zstd")
    parts = F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "groups")))
    rest = found.groupBy("row").agg(parts.alias("parts")).select("row", F.col("parts.groups").alias("rest_groups"), F.col("parts.chunk_id").alias("rest_ids"))
    none = {"rest_groups": "array<string>", "rest_ids": "array<long>"}
    both = docs.join(rest.hint("merge"), "row", "left").select("row", "doc_id", chunks(docs, split).alias("chunks"), *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])
    out = saved(both.mapInArrow(_put_together(sent), HELD), "assembled", compression="zstd", batch_rows=str(SLICE))
    sent.destroy()
    drop(found)
    return out, hot["chunk_id"].tolist()


def _small(df: DataFrame) -> DataFrame:
    """`df`, a written table, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pair_counts(parts: DataFrame) -> DataFrame:
    """Rows (pair, n, best) from parts (pair, n): the documents that have the pair linked, and whether no other pair of its A id has more."""
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", ID_BITS))  # a group is as large as B's vocabulary at most
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).cast("long").alias("best"))


def _hot_sums(held: DataFrame, sent) -> DataFrame:
    """Per document the sums over its hot chunks, from a matrix with a row for each of these."""

    def run(batches):
        for part in batches:
            counts, own = _flat(part.column("hot_ids"))
            times = _flat(part.column("hot_n"))[1].to_numpy(zero_copy_only=False)
            upto = np.concatenate([np.zeros((1, len(SUMS)), np.int64), np.cumsum(sent.value[own.to_numpy(zero_copy_only=False)] * times[:, None], axis=0)])
            ends = np.cumsum(counts)
            sums = upto[ends] - upto[ends - counts]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "doc_id", "groups_sha256")], *[pa.array(x) for x in sums.T.copy()]], names=["row", "doc_id", "groups_sha256", *SUMS])

    schema = "row long, doc_id long, groups_sha256 string, " + ", ".join(f"{c} long" for c in SUMS)
    return held.select("row", "doc_id", "groups_sha256", "hot_ids", "hot_n").mapInArrow(run, schema)


def op13_alignment(docs: DataFrame, ranks_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    tokens = tokenized(docs, ranks_path, b_path, hot)
    chunk_groups = saved(aligned(tokens), "groups", compression="zstd", all_keys="false")
    drop(tokens)
    both, hot_ids = assembled(docs, dictionary(chunk_groups), splits(b_path))
    held = both.where("row IS NOT NULL")
    pairs, sizes = saved(links(chunk_groups), "links", compression="zstd"), saved(chunk_sums(chunk_groups), "sizes", compression="zstd")
    drop(chunk_groups)
    counts = saved(pair_counts(both.where("row IS NULL").select("pair", "n")), "pairs")
    sums = pairs.join(_small(counts), "pair").groupBy("chunk_id").agg(F.sum(F.col("k") * F.col("best")).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    sums = saved(sizes.join(sums, "chunk_id"), "sums", compression="zstd")
    drop(pairs, sizes)
    # hot chunks without tokens, which are in no document that counts, have zeros
    hot = sums.where("hot").toPandas().set_index("chunk_id")[list(SUMS)].reindex(hot_ids, fill_value=0).to_numpy(np.int64)
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    rest = held.select("row", F.explode("rest_ids").alias("chunk_id")).join(sums.where(~F.col("hot")).hint("merge"), "chunk_id")
    rest = rest.groupBy("row").agg(*[F.sum(c).alias(f"rest_{c}") for c in SUMS])
    zero = F.lit(0).cast("long")
    none = docs.where("coalesce(text, '') = ''").select("doc_id", *[zero.alias(c) for c in SUMS], F.lit("").alias("groups_sha256"))
    out = _hot_sums(held, hot).join(rest, "row", "left")
    return out.select("doc_id", *[(F.col(c) + F.coalesce(f"rest_{c}", zero)).alias(c) for c in SUMS], "groups_sha256").unionByName(none)
