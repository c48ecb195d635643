"""Hilbert-curve sharding, in DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cell of that grid is replaced by its index on a
Hilbert curve, rows are put in curve order and the order is cut into runs of equal row counts. Neighbours on the
curve are neighbours in every dimension, so each shard has narrow ranges in all of them and files can be skipped on
any. Rows with equal texts follow each other and share a cell: that of the group's smallest row (doc_id, then lang, source, size lines).

The order is (cell on the curve, crc32 of the text, digest of the text, salt, doc_id); only groups of more than a thousandth of all rows have salts. The position
needs no total sort: groups are numbered within slices of the crc32 range, as many in a cell as its rows need (SLICE_ROWS), the slices' offsets are sums of counts,
and a row's place in its group is a rank among at most a thousandth of all rows. A shard's end may cut a group; nothing else does.

Nulls: a null text has no bytes and the crc of the empty text, and is equal to it; null dimensions fall into cell 0; null ids come first. Rows that repeat
are separate rows; which of them has which slot is undefined. Texts of any length are one row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_PART, saved, with_group

BITS = 4
SLICE_ROWS = 1_000_000
SALTS = 256
HEADER_BYTES = 8


def hilbert_table(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """All 2**(dims*bits) cells (`cell`: the dimensions' bits one after another) with their `curve` index.

    From the highest bit level down, each level's rotation of the axes is undone; then the Gray code is taken off.
    """
    out = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    cols = [F.shiftright(F.col("cell"), bits * d).bitwiseAND((1 << bits) - 1) for d in range(dims)]
    out = out.select("cell", F.array(*cols).alias("x"))
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            first, own = F.col("x")[0], F.col("x")[d]
            is_set = own.bitwiseAND(high) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            values = [F.col("x")[k] for k in range(dims)]
            values[0] = F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            if d:
                values[d] = F.when(is_set, own).otherwise(own.bitwiseXOR(swap))
            out = out.select("cell", F.array(*values).alias("x"))
    for d in range(1, dims):
        values = [F.col("x")[k] for k in range(dims)]
        values[d] = values[d].bitwiseXOR(values[d - 1])
        out = out.select("cell", F.array(*values).alias("x"))
    last = F.col("x")[dims - 1]
    flip = F.lit(0)
    for level in range(bits - 1, 0, -1):
        flip = F.when(last.bitwiseAND(1 << level) != 0, flip.bitwiseXOR((1 << level) - 1)).otherwise(flip)
    out = out.withColumn("flip", flip)
    curve = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            bit = F.shiftright(F.col("x")[d].bitwiseXOR(F.col("flip")), level).bitwiseAND(1)
            curve = curve * 2 + bit
    return out.select("cell", curve.alias("curve"))


def hashed_dimension(column: Column, bits: int = BITS) -> Column:
    """A categorical value as one of 2**bits grid lines; null is line 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(1 << bits)), F.lit(0))


def size_dimension(size: Column, bits: int = BITS) -> Column:
    """A byte size on a logarithmic scale: three lines for two doublings from 64 bytes on."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((F.log2(size) - 6) * 1.5))).cast("long")


def hilbert_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Every row of `docs` (doc_id, text, lang, source) with its size, crc32, curve index, shard and slot.

    Shard row counts differ by one at most; slots count from 0 in each shard without gaps.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + HEADER_BYTES
    rows = saved(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.struct(
                F.col("doc_id"),
                hashed_dimension(F.col("lang")).alias("a"),
                hashed_dimension(F.col("source")).alias("b"),
                size_dimension(size).alias("c"),
            ).alias("own"),
        ),
        "shard-rows",
    )
    total = rows.count()
    groups = rows.groupBy("digest", "text_crc32").agg(F.min("own").alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = F.col("lead")
    cell = lead["a"] + F.shiftleft(lead["b"], BITS) + F.shiftleft(lead["c"], 2 * BITS)
    # 2**12 rows, whatever the input
    groups = groups.withColumn("cell", cell).join(F.broadcast(hilbert_table(spark, 3)), "cell").select("digest", "text_crc32", "curve", "n")
    groups = saved(groups, "shard-groups")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda n, window: F.coalesce(F.sum(n).over(window), F.lit(0))
    cells = groups.groupBy("curve").agg(F.sum("n").alias("in_cell"))
    cells = cells.select(
        "curve",
        so_far("in_cell", before().orderBy("curve")).alias("cell_start"),  # 2**12 rows at most
        F.least(F.lit(32), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("in_cell") / SLICE_ROWS)))).cast("int").alias("bits"),
    )
    sliced = groups.join(F.broadcast(cells), "curve").withColumn("slice", F.expr("shiftright(text_crc32, 32 - bits)"))
    slices = sliced.groupBy("curve", "slice").agg(F.sum("n").alias("in_slice"))
    slices = slices.select("curve", "slice", so_far("in_slice", before("curve").orderBy("slice")).alias("slice_start"))
    placed = sliced.join(slices, ["curve", "slice"]).withColumn("in_front", so_far("n", before("curve", "slice").orderBy("text_crc32", "digest")))
    placed = placed.select("digest", "curve", "n", (F.col("cell_start") + F.col("slice_start") + F.col("in_front")).alias("start"))
    found = with_group(rows.select("doc_id", "size", "text_crc32", "digest"), placed, ["digest"], "n", total)
    # rows of large groups have salts, each of which is ranked alone
    hot = F.col("n") * HOT_PART > total
    found = found.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    own = Window.partitionBy("digest", "salt").orderBy("doc_id")
    found = saved(found.withColumn("rank", F.row_number().over(own) - 1), "shard-rows-placed")
    salts = found.where(hot).groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("in_salt"))
    # HOT_PART * SALTS rows at most
    salts = salts.select("digest", "salt", so_far("in_salt", before("digest").orderBy("salt")).alias("salt_start"))
    found = found.join(F.broadcast(salts), ["digest", "salt"], "left")
    return (
        found.withColumn("position", F.col("start") + F.coalesce("salt_start", F.lit(0)) + F.col("rank"))
        .withColumn("shard", F.expr(f"(position * {shards}) div {max(total, 1)}"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """`docs` with unique doc_id written as one folder per shard, rows in curve order for row-group pruning."""
    order = hilbert_shards(docs.select("doc_id", "text", "lang", "source"), shards).select("doc_id", "shard", "slot", "curve")
    out = docs.join(order, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def op1_hilbert(docs: DataFrame, shards: int = 24) -> DataFrame:
    return hilbert_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
