"""Current versions kept as a snapshot: a log of registrations merged into it, key by key, without the history behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written


def _same(content: list[str], other: str) -> Column:
    out = F.lit(True)
    for c in content:
        out &= F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return out


#: Rows of changes in a task, about.
TASK_ROWS = 100_000


def tasks_for(rows: int) -> int:
    """How many tasks `rows` rows are dealt over, so that a task's share does not grow with them."""
    return max(1, -(-rows // TASK_ROWS))


def _dealt(df: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def outcomes(snapshot: DataFrame, changes: DataFrame, keys: list[str], content: list[str], seq: str = "seq", tasks: int | None = None) -> DataFrame:
    """`changes` (*keys, seq, *content) with `outcome` and, for what makes a version, `version`.

    BEFORE: not later than the key's current version in `snapshot` (*keys, version, seq, *content, is_current); IMPORTED: the key's first; PRESENT: the content is that of
    the registration before; VERSION: it differs. A change that comes twice counts once. With `tasks` both are dealt over so many by key, else as the session does.
    """
    snapshot, changes = _dealt(snapshot.where("is_current"), keys, tasks), _dealt(changes, keys, tasks)
    head = snapshot.select(*keys, F.col("version").alias("__version"), F.col(seq).alias("__seq"), *[F.col(c).alias(f"__head_{c}") for c in content])
    rows = changes.select(*keys, seq, *content).dropDuplicates([*keys, seq]).join(head, keys, "left")
    before = F.coalesce(F.col(seq) <= F.col("__seq"), F.lit(False))
    rows = rows.withColumn("__before", before)
    # changes of before stand apart, so a repeated log meets the snapshot's content first
    w = Window.partitionBy(*keys, "__before").orderBy(seq)
    rows = rows.withColumn("__first", F.row_number().over(w) == 1).withColumns({f"__prev_{c}": F.lag(c).over(w) for c in content})
    same = F.when(F.col("__first"), F.col("__seq").isNotNull() & _same(content, "__head_")).otherwise(_same(content, "__prev_"))
    outcome = F.when(F.col("__before"), "BEFORE").when(F.col("__first") & F.col("__seq").isNull(), "IMPORTED").when(same, "PRESENT").otherwise("VERSION")
    rows = rows.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("IMPORTED", "VERSION")
    number = F.coalesce("__version", F.lit(0)) + F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, seq, *content, "outcome", F.when(fresh, number).alias("version"))


def merged(snapshot: DataFrame, changes: DataFrame, keys: list[str], content: list[str], seq: str = "seq", tasks: int | None = None) -> DataFrame:
    """The snapshot after the changes: new versions behind the old ones, the last of each key current. Merging a log again changes nothing."""
    fresh = outcomes(snapshot, changes, keys, content, seq, tasks).where("version IS NOT NULL").select(*keys, "version", seq, *content)
    last = fresh.groupBy(*keys).agg(F.max("version").alias("__last"))
    new = fresh.join(last, keys).withColumn("is_current", F.col("version") == F.col("__last")).drop("__last")
    old = _dealt(snapshot, keys, tasks).join(last, keys, "left").withColumn("is_current", F.col("is_current") & F.col("__last").isNull()).drop("__last")
    columns = [*keys, "version", seq, *content, "is_current"]
    return old.select(columns).unionByName(new.select(columns))


def empty(changes: DataFrame, keys: list[str], content: list[str], seq: str = "seq") -> DataFrame:
    """A snapshot without versions for changes of this form."""
    shape = changes.select(*keys, F.lit(0).cast("long").alias("version"), seq, *content, F.lit(True).alias("is_current"))
    return changes.sparkSession.createDataFrame([], shape.schema)


def merge_into(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], content: list[str], buckets: int, seq: str = "seq") -> None:
    """The snapshot stored at `path`, in `buckets` folders by hash of the key, after the changes. Only folders with a changed key are read and written.

    The new folders are written beside first; a run that breaks off before the last step leaves the snapshot as it was, and a repeated one
    ends the same.
    """
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")
    changes = changes.withColumn("bucket", bucket)
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # at most `buckets`
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket") if exists and touched else empty(changes, keys, content, seq)
    new = written(merged(old, changes.drop("bucket"), keys, content, seq).withColumn("bucket", bucket), "snapshot")
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
