"""Quality rules: a table of thresholds compiled into one projection of native expressions.

measures() counts what the rules look at; compiled() turns a rule table (name, measure, per, least, most) into columns that
compare 1000 * measure with bounds times `per`, in integers, so that no rounding decides. A rule without `per` compares the measure itself.

Words are maximal runs of anything but the six ASCII spaces. Repeated 3-word windows are found without a join: every window is a long of 44
hash bits and 20 position bits; a sort of the longs puts equal windows side by side, and every such pair is compared word by word. Where two
different windows share the hash bits, or a text has 2**20 words or more, the windows themselves are sorted instead.

Nulls: a null text has no words, symbols or lines, and fails. An empty text likewise. Rows that repeat are separate rows.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by at from this have are or an "
    "der die das und in zu den von mit ist des ein eine auf für nicht sich dem im auch "
    "le la les de des et en un une que est pour qui dans du au sur pas par "
    "el los las del y se por con una para su al lo como más"
).split()

# (name, measure, per, least, most): least <= 1000 * measure / per <= most; None: no bound.
RULES = (
    ("word_length", "word_chars", "n_words", 2000, 15000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("stop_words", "n_stop_words", "n_words", 10, None),
    ("upper_words", "n_upper_words", "n_words", None, 500),
    ("letter_words", "n_letter_words", "n_words", 600, None),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
)
SPACES = r"[\x20\x09-\x0D]+"
POSITION_BITS = 20


def compiled(rules=RULES) -> dict[str, Column]:
    """A boolean column per rule of the table."""
    out = {}
    for name, measure, per, least, most in rules:
        value, unit = (F.col(measure) * 1000, F.col(per)) if per else (F.col(measure), F.lit(1))
        ok = F.lit(True)
        if least is not None:
            ok &= value >= unit * least
        if most is not None:
            ok &= value <= unit * most
        out[f"rule_{name}"] = ok
    return out


def _repeated(positions: Column) -> Column:
    """Words covered by 3-word windows at sorted, distinct positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with `words`."""
    low = (1 << POSITION_BITS) - 1
    no_longs = F.array().cast("array<bigint>")
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    keys = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.col("h")[i], F.col("h")[i + 1], F.col("h")[i + 2]).bitwiseAND(~low).bitwiseOR(i.cast("long")),
    )
    fits = F.size("words").between(3, low)
    df = df.withColumn("keys", F.when(fits, F.sort_array(keys)).otherwise(no_longs))
    same = F.filter(
        F.sequence(F.lit(1), F.size("keys") - 1), lambda j: F.col("keys")[j].bitwiseXOR(F.col("keys")[j - 1]).bitwiseAND(~low) == 0
    )
    pairs = F.transform(same, lambda j: F.struct(F.col("keys")[j - 1].bitwiseAND(low).cast("int").alias("a"), F.col("keys")[j].bitwiseAND(low).cast("int").alias("b")))
    no_pairs = F.array().cast("array<struct<a:int,b:int>>")
    df = df.withColumn("pairs", F.when(F.size("keys") > 1, pairs).otherwise(no_pairs))
    word = F.col("words")
    differ = F.exists("pairs", lambda p: (word[p["a"]] != word[p["b"]]) | (word[p["a"] + 1] != word[p["b"] + 1]) | (word[p["a"] + 2] != word[p["b"] + 2]))
    df = df.withColumn("plain", (F.size("words") > low) | differ)
    by_hash = F.sort_array(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"].cast("long"), p["b"].cast("long"))))))
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(F.struct(word[i].alias("x"), word[i + 1].alias("y"), word[i + 2].alias("z")).alias("w"), i.cast("long").alias("i")),
        )
    )
    empty = F.array().cast("array<struct<w:struct<x:string,y:string,z:string>,i:bigint>>")
    df = df.withColumn("windows", F.when(F.col("plain"), windows).otherwise(empty))
    at, last = F.col("windows"), F.size("windows") - 1
    again = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: F.when(j > 0, at[j]["w"] == at[j - 1]["w"]).otherwise(False) | F.when(j < last, at[j]["w"] == at[j + 1]["w"]).otherwise(False),
    )
    by_words = F.sort_array(F.transform(again, lambda j: at[j]["i"]))
    positions = F.when(F.col("plain"), by_words).when(F.size("pairs") > 0, by_hash).otherwise(no_longs)
    return df.withColumn("positions", positions).withColumn("n_repeat_words", _repeated(F.col("positions")))


def measures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id and the counts that rules can use)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("t"))
    df = df.withColumn("words", F.array_remove(F.split("t", SPACES), "")).withColumn("lines", F.split("t", "\n"))
    df = df.withColumn("lines", F.filter("lines", lambda x: F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""))
    df = df.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
        F.regexp_count(F.array_join("words", " "), F.lit(r"\p{L}[^\x20]*")).cast("long").alias("n_letter_words"),
    )
    return _with_repeats(df).drop("words", "h", "keys", "pairs", "plain", "windows", "positions")


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """measures() with base_failed, a column per rule, and `kept`: no failure of either."""
    checks = compiled(rules)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = ~failed
    for ok in checks.values():
        verdict &= ok
    return measures(docs).withColumns({"base_failed": failed, **checks, "kept": verdict})


def op6_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *compiled()
    )
