"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: literals give the conjunction of their trigrams, alternatives a
disjunction, optional parts nothing. The index holds postings (trigram, row) of lower-cased texts for the trigrams that some query mentions. Postings are
intersected per row: a rule's candidates are the rows in which one of its conjunctions has all its trigrams. Rules whose query is empty
scan every row. Candidates are verified with the regular expression itself, on the whole text; a span's start is what stands between the
matches before it, counted in code points.

Rows are known by a 64-bit hash of id and text. Two rows that share one only lend each other candidates, which the verification settles.

Nulls: a null text is empty. Rows that repeat are separate rows with equal results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """regex: what is matched, leftmost first, without overlaps; a match counts if group `group` has `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base kinds, then kinds that this method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),  # a run of these characters has one match, so the least length can stand in the regex
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def literal_runs(regex: str) -> list[list[str]]:
    """The alternatives that a match must contain, each as its mandatory literal runs, in lower case.

    Groups of alternatives are expanded; whatever else is not a literal character ends a run, and an optional character ends it too.
    """
    import re._parser as parser  # the regular expression as Python parses it

    def join(heads, tails):
        return [[*h[:-1], h[-1] + t[0], *t[1:]] for h in heads for t in tails]

    def walk(parsed):
        found = [[""]]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                part = [[chr(arg).lower()]]
            elif name == "SUBPATTERN":
                part = walk(arg[3])
            elif name == "BRANCH":
                part = [x for branch in arg[1] for x in walk(branch)]
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                part = [["", *[r for r in x if r], ""] for x in walk(arg[2])]
            else:
                part = [["", ""]]
            found = join(found, part)
            if len(found) > 64:
                return [["", ""]]
        return found

    return [[run for run in runs if run] for runs in walk(parser.parse(regex))]


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Disjunction of conjunctions of trigrams; empty where some alternative has no mandatory trigram."""
    clauses = [frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in literal_runs(regex)]
    return [] if any(not c for c in clauses) else sorted(set(clauses), key=sorted)


def indexed_trigrams(text: Column, rules=RULES) -> Column:
    """The distinct trigrams of a lower-cased text that stand in the index's vocabulary."""
    tails: dict[str, list[str]] = {}
    for gram in sorted({g for r in rules for c in trigram_query(r.regex) for g in c}):
        tails.setdefault(gram[0], []).append(re.escape(gram[1:]))
    # one lookahead for the whole vocabulary finds overlapping places in one pass
    regex = "(?=(" + "|".join(f"{re.escape(head)}(?:{'|'.join(rest)})" for head, rest in tails.items()) + "))"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(regex), F.lit(1)))


def postings(keyed: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index of rows (row_key, text) as a table (trigram, row_key)."""
    return keyed.select(F.explode(indexed_trigrams(F.col("text"), rules)).alias("trigram"), "row_key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Rows (row_key, __kinds): intersects postings by clause, then unites the clauses of a rule."""
    clauses = [(rule.kind, k, len(clause), gram) for rule in rules for k, clause in enumerate(trigram_query(rule.regex)) for gram in sorted(clause)]
    terms = index.sparkSession.createDataFrame(clauses, "kind string, clause int, needed int, trigram string")  # a line per rule, clause and trigram
    met = index.join(F.broadcast(terms), "trigram").groupBy("row_key", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needed").groupBy("row_key").agg(F.collect_set("kind").alias("__kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, in code points; matches that are too short are dropped after matching."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    between = F.split(text, rule.regex, -1)
    measured = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(
        F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("skip"), F.length(w).alias("n"))),
        measured,
        lambda s, m: F.struct(s["skip"].alias("skip"), s["n"].alias("n"), F.length(m).alias("m")),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    # zip_with pads with null: the text after the last match has no match
    steps = F.filter(steps, lambda s: s["n"].isNotNull())
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + s["skip"] + s["n"]).alias("at"),
            F.when(
                s["m"] >= rule.least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + s["skip"]).alias("start"), (acc["at"] + s["skip"] + s["n"]).alias("end")))),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """`docs` with `secrets`: an array of (start, kind_number, end, kind), sorted."""
    columns = [c for c in docs.columns if c != "secrets"]
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64("doc_id", text)
    found_in = candidates(postings(docs.select(key.alias("row_key"), text.alias("text")), rules), rules).withColumnRenamed("row_key", "__found_key")
    df = docs.select(*columns, text.alias("__text"), key.alias("__key"))
    df = df.join(found_in.hint("shuffle_hash"), F.col("__key") == F.col("__found_key"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    for rule in rules:
        worth = F.col("__text").rlike(rule.regex)
        if trigram_query(rule.regex):
            worth = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) & worth
        df = df.withColumn(f"__{rule.kind}", F.when(worth, spans(F.col("__text"), rule)).otherwise(none))
    found = [_labelled(F.col(f"__{rule.kind}"), k, rule.kind) for k, rule in enumerate(rules)]
    return df.select(*columns, F.array_sort(F.concat(*found)).alias("secrets"))


def _labelled(found: Column, number: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_number"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _of_kinds(*kinds: str) -> Column:
    return F.filter("secrets", lambda s: s["kind"].isin(*kinds))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, rules=RULES) -> DataFrame:
    """`docs` with every secret in `text` replaced by [KIND]; of overlapping spans the first to start covers the rest."""
    # the caller's columns stand apart, so none of them meets a name used here
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    df = scan(docs.select(kept, "doc_id", "text"), rules)
    cut = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["parts"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("secrets") > 0, cut).otherwise(F.col("text"))
    return df.withColumn("text", text).select(*[F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])


def op9_trigram_index(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    counts = [F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = _of_kinds(*BASE)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
