"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed; a polynomial over the hashes of the last WINDOW lines (the value of a rolling hash, whose terms a projection adds up at every place) closes a
chunk after a line where it falls on a multiple of AVERAGE. Boundaries depend on the nearby lines alone, so a passage is cut alike wherever it stands, and
insertions before it shift nothing. A chunk is cut after MOST_LINES lines at the latest. Besides the whole chunk, the shortest run from each line on
and the shortest run up to each line are entries, of two lines or more and of `least_bytes` bytes or more: a repeated run of lines of that size is found from its first
line to its last, wherever the boundaries fall. (Each of its lines is in one of these runs within it. Only where MOST_LINES neighbouring lines together stay below
`least_bytes` is there no run.) By default every repeated run of two lines or more goes that is not all empty lines.

An entry that occurs again anywhere is a candidate by its hash; the candidates' bytes are compared with those of the entry's first occurrence (by doc_id,
then by place), and the lines of equal later occurrences are removed. The first occurrence stays, so every distinct line stays somewhere. Entries
below `least_bytes` are left alone. Occurrences are pre-aggregated by hash before anything is joined, and an entry of more than a thousandth of all
occurrences is joined where they are. Texts are read whole; of occurrences that tie in doc_id the first by text hash is the one that stays.

A document is its id and text, by a hash of 128 bits: rows that repeat both count as one and lose the same lines. Nulls: a null text has no lines and stays null; a null id comes
first. An empty text is one empty line and stays. A text whose lines are all removed becomes empty. An empty table gives an empty
result. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mark, row_id, saved, with_group

AVERAGE = 4
WINDOW = 3
RADIX, PRIME = 1_000_003, (1 << 31) - 1
MOST_LINES = 16
LEAST_BYTES = 1
LONG_WORDS = 50
SALTS = 8
PLACE = 64  # over MOST_LINES


def _cuts(hashes: Column) -> Column:
    """Sorted numbers of the lines (from 0) after which a chunk ends; hashes: below PRIME."""
    n = F.size(hashes)
    weight = [pow(RADIX, k, PRIME) for k in range(WINDOW)]
    rolled = lambda i: sum(F.when(i >= k, F.get(hashes, i - k) * w % PRIME).otherwise(0) for k, w in enumerate(weight))
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (rolled(i) % PRIME % AVERAGE == 0))


def _chunks(cuts: Column) -> Column:
    """(start, n) of the chunks between the cuts, none longer than MOST_LINES."""
    spans = F.transform(cuts, lambda c, k: F.struct(F.when(k > 0, cuts[F.greatest(k - 1, F.lit(0))] + 1).otherwise(F.lit(0)).alias("start"), c.alias("last")))
    parts = F.transform(
        spans,
        lambda s: F.transform(
            F.sequence(s["start"], s["last"], F.lit(MOST_LINES)),
            lambda a: F.struct(a.alias("start"), F.least(F.lit(MOST_LINES), s["last"] - a + 1).alias("n")),
        ),
    )
    return F.flatten(parts)


def _shortest(b: Column, first: Column, n: Column, flip: bool, least: int) -> Column:
    """How many of the `n` lines from `first` on (`flip`: of those, from the last one back) make the shortest run; null where they don't."""
    part = F.slice(b, first + 1, n)
    enough = lambda x: (x["n"] >= 2) & (x["b"] >= least)
    return F.aggregate(
        F.reverse(part) if flip else part,
        F.struct(F.lit(0).alias("b"), F.lit(0).alias("n")),
        lambda x, y: F.when(enough(x), x).otherwise(F.struct((x["b"] + y).alias("b"), (x["n"] + 1).alias("n"))),
        lambda x: F.when(enough(x), x["n"]),
    )


def _long(line: Column) -> Column:
    """Whether the line has LONG_WORDS words or more."""
    # so many words have so many bytes, and as many spaces less one between them
    return F.when(F.octet_length(line) >= 2 * LONG_WORDS - 1, F.regexp_count(line, F.lit(r"\S+")) >= LONG_WORDS).otherwise(F.lit(False))


def _entries(chunks: Column, b: Column, long: Column, least: int) -> Column:
    """Numbers start * PLACE + n of the chunks of two lines or more, of the shortest runs from each line and up to each line, and of the `long` lines.

    `b`: bytes of the lines."""
    size, most = F.size(b), F.lit(MOST_LINES)
    number = lambda start, n: start.cast("long") * PLACE + n
    pair = lambda i: (F.get(b, i) + F.get(b, i + 1)) >= least
    every = F.sequence(F.lit(0), size - 1)
    whole = F.transform(F.filter(chunks, lambda c: c["n"] > 1), lambda c: number(c["start"], c["n"]))
    onward = F.transform(every, lambda i: number(i, F.when(pair(i), F.lit(2)).otherwise(_shortest(b, i, most, False, least))))

    def up_to(i):
        first = F.greatest(i + 1 - most, F.lit(0))
        n = _shortest(b, first, i + 1 - first, True, least)
        # a pair is the run from its first line on
        return F.when((i > 0) & ~F.coalesce(pair(i - 1), F.lit(False)), number(i + 1 - n, n))

    single = F.transform(F.filter(every, lambda i: long[i]), lambda i: number(i, F.lit(1)))
    return F.filter(F.array_distinct(F.concat(whole, onward, F.transform(every, up_to), single)), lambda e: e.isNotNull())


def entries(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows (row_key, doc_id, start, n, hash, alone): every entry of every document with a text; `alone`: the text is one line."""
    rows = docs.where(F.col("text").isNotNull()).select("row_key", "doc_id", F.split("text", "\n").alias("lines"))
    rows = rows.select(
        "row_key",
        "doc_id",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.octet_length(x)).alias("b"),
        F.transform("lines", _long).alias("long"),
        (F.size("lines") == 1).alias("alone"),
    )
    rows = rows.withColumn("small", F.transform("h", lambda h: F.pmod(h, F.lit(PRIME))))
    rows = rows.withColumn("cuts", _cuts(F.col("small")))
    rows = rows.withColumn("chunks", _chunks(F.col("cuts")))
    rows = rows.withColumn("e", F.when((F.size("chunks") > 0) & (F.size("long") > 0), _entries(F.col("chunks"), F.col("b"), F.col("long"), least_bytes)))
    at = lambda e: F.struct(F.floor(e / PLACE).cast("int").alias("start"), (e % PLACE).cast("int").alias("n"))
    rows = rows.withColumn("e", F.transform("e", at))
    # the entries are measured before they become rows, so that no row carries its document's arrays
    part = lambda c, e: F.slice(F.col(c), e["start"] + 1, e["n"])
    measured = F.transform(
        "e",
        lambda e: F.struct(
            e["start"].alias("start"), e["n"].alias("n"), F.xxhash64(part("h", e)).alias("hash"), F.aggregate(part("b", e), F.lit(0), lambda x, y: x + y).alias("n_bytes")
        ),
    )
    rows = rows.withColumn("e", F.when((F.size("h") > 0) & (F.size("b") > 0), F.filter(measured, lambda e: e["n_bytes"] >= least_bytes)))
    # explode() would evaluate the whole expression once more in a filter on its size
    rows = rows.select("row_key", "doc_id", "alone", F.explode_outer("e").alias("e")).where("e IS NOT NULL")
    return rows.select("row_key", "doc_id", "e.start", "e.n", "e.hash", "alone")


def repeated_lines(docs: DataFrame, whole: bool = True, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows (row_key, lines): the numbers of the lines to be removed from each document with (row_key, doc_id, text)."""
    since = mark()
    found = saved(entries(docs, least_bytes), "line-entries")
    # most hashes occur once: counts alone leave those out, before any entry is moved
    times = found.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = saved(with_group(found, times, ["hash"], "times", found.count()).drop("times"), "line-shared")
    discard(since)
    order = F.struct("doc_id", "row_key", "start", "alone")
    # rows that repeat are one document: occurrences are told apart by (row_key, start)
    first = shared.groupBy("hash").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("times"))
    again = with_group(shared, first, ["hash"], "times", shared.count()).where(~((F.col("row_key") == F.col("lead.row_key")) & (F.col("start") == F.col("lead.start"))))
    if not whole:
        again = again.where(~(F.col("alone") & F.col("lead.alone")))
    # an entry within a longer one that also occurs earlier adds no line: only the outermost are compared
    inner = Window.partitionBy("row_key").orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    again = again.withColumn("reach", F.max(F.col("start") + F.col("n")).over(inner)).where("reach IS NULL OR reach < start + n")
    again = saved(again.select("row_key", "start", "n", "hash", "lead").distinct(), "line-again")
    discard(since)
    leads = again.select(F.col("lead.row_key").alias("row_key"), F.col("lead.start").alias("start"), "n", "hash").distinct()
    wanted = again.select("row_key", "start", "n", "hash").union(leads).distinct()
    wanted = wanted.groupBy("row_key").agg(F.collect_list(F.struct("start", "n", "hash")).alias("entries"))  # as many as a document has lines, times two
    texts = docs.select("row_key", "text").join(wanted.hint("shuffle_hash"), "row_key")
    texts = texts.select("row_key", F.split("text", "\n").alias("lines"), "entries")
    with_bytes = F.transform(
        "entries",
        lambda e: F.struct(
            e["start"].alias("start"), e["n"].alias("n"), e["hash"].alias("hash"), F.array_join(F.slice(F.col("lines"), e["start"] + 1, e["n"]), "\n").alias("bytes")
        ),
    )
    texts = texts.select("row_key", F.explode_outer(F.when(F.size("lines") > 0, with_bytes)).alias("e")).select("row_key", "e.start", "e.n", "e.hash", "e.bytes")
    texts = saved(texts, "line-bytes")
    place = ["row_key", "start", "hash"]
    leads = texts.join(leads.select(*place), place, "left_semi").groupBy("hash").agg(F.first("bytes").alias("lead_bytes"))
    # a hash's occurrences are dealt over SALTS tasks, and its first one goes to each
    salted = again.select(*place).withColumn("salt", F.pmod(F.xxhash64("row_key", "start"), F.lit(SALTS)))
    leads = leads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    equal = texts.join(salted, place).join(leads, ["hash", "salt"]).where("bytes = lead_bytes")
    lines = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    removed = saved(equal.groupBy("row_key").agg(F.sort_array(F.array_distinct(lines)).alias("removed")), "line-removed")
    discard(since)  # what was written on the way is spent
    return removed


def dedup_lines(docs: DataFrame, whole: bool = True, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """`docs` with the text that stays, and `removed_lines`: the numbers of the lines that went (null: none).

    Without `whole`, a text of one line that repeats another text of one line stays, for a later step that removes whole copies."""
    columns = [c for c in docs.columns if c not in ("removed_lines", "text")]
    key = row_id()
    keyed = docs.select(key.alias("row_key"), "doc_id", "text")
    gone = repeated_lines(keyed, whole, least_bytes).select(F.col("row_key").alias("__key"), "removed")
    # the caller's columns stand apart, so none of them meets a name used here
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__kept") if columns else F.lit(0).alias("__kept")
    out = docs.select(kept, "text", key.alias("__own")).join(gone.hint("shuffle_hash"), F.col("__own") == F.col("__key"), "left")
    # runs of lines that stay: between -1, the removed lines and the end
    lines = F.split("text", "\n")
    out = out.withColumn("__lines", F.when(F.col("removed").isNotNull(), lines))
    fence = F.concat(F.array(F.lit(-1)), F.col("removed"), F.array(F.size("__lines")))
    out = out.withColumn("__fence", F.when(F.col("removed").isNotNull(), fence))
    stays = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("__fence") - 1),
            lambda k: F.slice(F.col("__lines"), F.col("__fence")[k - 1] + 2, F.col("__fence")[k] - F.col("__fence")[k - 1] - 1),
        )
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return out.select(*[F.col("__kept")[c].alias(c) for c in columns], text.alias("text"), F.col("removed").alias("removed_lines"))


def op7_line_chunks(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
    )
