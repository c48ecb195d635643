"""Queries over sessions, reviews, versions, sets and documents, each with the DuckDB statement that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import reconcile as R
from ..operators import windows as W
from ..session import table
from ..sources.observations import OBS_SQL, observations


def contribution_ladder(spark, sf_dir):
    """Orders as sessions: the first rule that holds decides, and the failed minima are listed."""
    o = table(spark, sf_dir, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    why = F.filter(F.array(F.when(price < 50_000, "short_tracked_time"), F.when(F.col("o_orderpriority").startswith("5"), "low_confidence"), F.when(F.col("o_custkey") % 7 == 0, "many_fragments")), lambda x: x.isNotNull())
    o = o.withColumn("why", why)
    outcome = H.ladder((price < 5_000, "EXCLUDED"), (status == "P", "PROVISIONAL"), (price.isNull(), "NOT_EVALUATED"), (F.size("why") > 0, "EXCLUDED"), otherwise="INCLUDED")
    return o.select("o_orderkey", outcome.alias("contribution"), F.array_join("why", ",").alias("reasons"))


LADDER_SQL = """
WITH w AS (SELECT *, list_filter([CASE WHEN o_totalprice < 50000 THEN 'short_tracked_time' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low_confidence' END, CASE WHEN o_custkey % 7 = 0 THEN 'many_fragments' END], lambda x: x IS NOT NULL) AS why FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'EXCLUDED' WHEN o_orderstatus = 'P' THEN 'PROVISIONAL' WHEN o_totalprice IS NULL THEN 'NOT_EVALUATED' WHEN len(why) > 0 THEN 'EXCLUDED' ELSE 'INCLUDED' END AS contribution,
  array_to_string(why, ',') AS reasons FROM w
"""


def _split(spark, sf_dir):
    return H.even_split(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


def chronological_split(spark, sf_dir):
    """The newest eight orders of a customer in two halves of one size; the middle one of an odd number has none, as have all of fewer than four."""
    return _split(spark, sf_dir).select("o_custkey", "o_orderkey", "split", "n")


SPLIT_CTE = """
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM b WHERE back <= 8),
sp AS (SELECT *, CASE WHEN n < 4 THEN NULL WHEN back <= n // 2 THEN 'recent' WHEN back > n - n // 2 THEN 'earlier' END AS split FROM n)"""
SPLIT_SQL = f"WITH {SPLIT_CTE} SELECT o_custkey, o_orderkey, split, n FROM sp"


def ratio_of_sums_trend(spark, sf_dir):
    """Discounted price per piece of the earlier and recent orders, and the shares of the three return flags; fewer than four orders give no trend."""
    rows = _split(spark, sf_dir).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    out = rows.groupBy("o_custkey", "n").agg(
        *[F.sum(F.when(F.col("split") == s, cents)).alias(f"{s}_cents") for s in ("earlier", "recent")],
        *[F.sum(F.when(F.col("split") == s, F.col("l_quantity"))).alias(f"{s}_pieces") for s in ("earlier", "recent")],
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).alias(f"pieces_{f}") for f in "ANR"],
        F.sum("l_quantity").alias("pieces"),
        F.max("l_quantity").alias("largest"),
    )
    earlier, recent = (F.try_divide(F.col(f"{s}_cents"), F.col(f"{s}_pieces")) for s in ("earlier", "recent"))
    change = (recent - earlier) / 100
    return out.select(
        "o_custkey",
        F.round(earlier, 6).alias("earlier"),
        F.round(recent, 6).alias("recent"),
        H.trend(change, 50.0).alias("trend"),
        *[F.round(F.try_divide(F.col(f"pieces_{f}"), F.col("pieces")) * 100, 6).alias(f"share_{f.lower()}") for f in "ANR"],
        (F.col("largest") > 0.6 * F.col("pieces")).alias("dominated"),
    )


TREND_SQL = f"""
WITH {SPLIT_CTE},
j AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents FROM sp JOIN lineitem ON o_orderkey = l_orderkey),
a AS (SELECT o_custkey, n, sum(cents) FILTER (split = 'earlier') / sum(l_quantity) FILTER (split = 'earlier') AS earlier, sum(cents) FILTER (split = 'recent') / sum(l_quantity) FILTER (split = 'recent') AS recent,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS nn, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r, sum(l_quantity) AS pieces, max(l_quantity) AS largest
  FROM j GROUP BY 1, 2)
SELECT o_custkey, round(earlier, 6) AS earlier, round(recent, 6) AS recent, CASE WHEN abs((recent - earlier) / 100) < 50 THEN 'STABLE' WHEN recent > earlier THEN 'HIGHER' WHEN recent < earlier THEN 'LOWER' END AS trend,
  round(a / pieces * 100, 6) AS share_a, round(nn / pieces * 100, 6) AS share_n, round(r / pieces * 100, 6) AS share_r, largest > 0.6 * pieces AS dominated FROM a
"""


def most_common_category(spark, sf_dir):
    """The return flag with the most pieces of each supplier, the first by name on a tie."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("pieces"))
    return W.first_row(sums, ["l_suppkey"], [F.desc("pieces"), F.col("l_returnflag")])


COMMON_SQL = """
SELECT l_suppkey, l_returnflag, sum(l_quantity) AS pieces FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_returnflag) = 1
"""


def history_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.count_if(F.col("o_orderstatus") == s).alias(f"status_{s.lower()}") for s in "FOP"],
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
    )


COUNTS_SQL = """
SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p,
  sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1
"""


def page_newest_first(spark, sf_dir):
    """The second page of five of each customer's orders, newest first."""
    page = H.newest_first(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 5)
    return page.select("o_custkey", "rank", "o_orderkey")


PAGE_SQL = """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank, o_orderkey FROM orders
QUALIFY rank BETWEEN 6 AND 10
"""


def duplicate_by_checksum(spark, sf_dir):
    """Documents whose text another row of the same source has too, with the newest (largest) id of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    groups = d.groupBy("source", "checksum").agg(F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return d.join(groups, ["source", "checksum"]).select("doc_id", "latest", "copies", F.substring("checksum", 1, 16).alias("checksum"))


CHECKSUM_SQL = """
WITH d AS (SELECT doc_id, source, sha256(text) AS checksum FROM documents)
SELECT doc_id, max(doc_id) OVER w AS latest, count(*) OVER w AS copies, checksum[1:16] AS checksum FROM d WINDOW w AS (PARTITION BY source, checksum) QUALIFY copies > 1
"""


def confusion_matrix(spark, sf_dir):
    """Four size grades against a grade by quality and toxicity: the dense matrix with exact and near agreement."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    system = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 1500, 1).when(F.col("n_chars") < 3000, 2).otherwise(3)
    counts = d.groupBy((F.col("quality") * 2 + 1 - F.col("toxic")).cast("int").alias("expected"), system.alias("system")).agg(F.count(F.lit(1)).alias("n"))
    four = F.array(*[F.lit(i) for i in range(4)])
    dense = spark.range(1).select(F.explode(four).alias("expected")).select("expected", F.explode(four).alias("system"))
    out = dense.join(counts, ["expected", "system"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    percent = F.bround(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("expected"))) * 100, 1)
    delta = F.col("system") - F.col("expected")
    return out.select("expected", "system", "n", percent.alias("percent"), (delta == 0).alias("exact"), (F.abs(delta) <= 1).alias("acceptable"))


CONFUSION_SQL = """
WITH g AS (SELECT (quality * 2 + 1 - toxic)::INTEGER AS expected, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1500 THEN 1 WHEN n_chars < 3000 THEN 2 ELSE 3 END AS system FROM documents JOIN labels USING (doc_id)),
d AS (SELECT e::INTEGER AS expected, s::INTEGER AS system FROM range(4) a(e), range(4) b(s)),
c AS (SELECT d.expected, d.system, count(g.expected) AS n FROM d LEFT JOIN g ON d.expected = g.expected AND d.system = g.system GROUP BY 1, 2)
SELECT expected, system, n, round_even(n / nullif(sum(n) OVER (PARTITION BY expected), 0)::DOUBLE * 100, 1) AS percent, system = expected AS exact, abs(system - expected) <= 1 AS acceptable FROM c
"""


def dataset_balance(spark, sf_dir):
    """Documents by category and value, with whether a value is too rare."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("x")).select("x.*")
    return rows.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < 45).alias("under_represented"))


BALANCE_SQL = """
SELECT category, value, count(*) AS n, count(*) < 45 AS under_represented FROM (SELECT 'lang' AS category, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2
"""


def reconcile_full_outer(spark, sf_dir):
    """All documents with a derived value against their labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("v"))
    found = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("v"))
    return R.reconcile(d, found, "doc_id", "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


RECONCILE_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS v FROM documents), l AS (SELECT doc_id, toxic AS v FROM labels),
j AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' WHEN d.doc_id IS NULL THEN 'ORPHAN' WHEN d.v IS DISTINCT FROM l.v THEN 'MISMATCH' ELSE 'OK' END AS status FROM d FULL JOIN l ON d.doc_id = l.doc_id)
SELECT status, count(*) AS n, min(doc_id) AS first_id FROM j GROUP BY 1
"""


def anti_semi_checks(spark, sf_dir):
    """Customers without an order (anti), and customers with an urgent one (semi)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey") == F.col("o_custkey")
    without = c.join(o, key, "left_anti").select("c_custkey", F.lit("no_order").alias("kind"))
    urgent = c.join(o.where("o_orderpriority = '1-URGENT'"), key, "left_semi").select("c_custkey", F.lit("urgent").alias("kind"))
    return without.unionByName(urgent)


ANTI_SQL = """
SELECT c_custkey, 'no_order' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
"""


def set_operations(spark, sf_dir):
    """Players by the sets of event types they have: intersection, difference and union of two, with a symmetric count."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select("user_id").distinct()
    b = e.where("value > 90").select("user_id").distinct()
    named = lambda df, name: df.select("user_id", F.lit(name).alias("part"))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first_only")).unionByName(named(b.subtract(a), "second_only")).unionByName(named(a.union(b).distinct(), "either"))


SETS_SQL = """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 90)
SELECT user_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'first_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT user_id, 'second_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT user_id, 'either' FROM (SELECT * FROM a UNION SELECT * FROM b)
"""


def transition_audit(spark, sf_dir):
    """Steps from a turn to the next that are not user > assistant > user, or skip a number: in the conversations, and where every third order is taken as a state that follows the one before."""
    allowed = [("user", "assistant"), ("assistant", "user"), ("system", "user")]
    orders = table(spark, sf_dir, "orders").selectExpr(
        "-1 - o_custkey AS conv_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 0 END AS turn",
        "CASE o_orderkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'system' END AS role",
    )
    turns = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "turn", "role").unionByName(orders)
    bad = R.audit_transitions(turns, ["conv_id"], ["turn"], "role", allowed)
    return bad.select("conv_id", "turn", "from_state", "role", "step")


AUDIT_SQL = """
WITH u AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role FROM conversations UNION ALL SELECT -1 - o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 0 END,
    CASE o_orderkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'system' END FROM orders),
t AS (SELECT conv_id, turn, lag(role) OVER w AS from_state, role, turn - lag(turn) OVER w AS step FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT * FROM t WHERE from_state IS NOT NULL AND ((from_state || '>' || role) NOT IN ('user>assistant', 'assistant>user', 'system>user') OR step <> 1)
"""


def current_version(spark, sf_dir):
    rows = R.current_version(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", "version", "is_current", "replaces")


VERSION_SQL = """
SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lead(o_orderkey) OVER w IS NULL AS is_current, lag(o_orderkey) OVER w AS replaces FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""


def similarity_pairs(spark, sf_dir):
    """Per label the cosine similarity of every vector to the label's first vector."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    first = W.first_row(e, ["label"], [F.col("vec_id")]).select("label", F.col("v").alias("u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "u") / F.sqrt(dot("v", "v") * dot("u", "u"))
    return e.join(first, "label").select("vec_id", "label", F.round(cosine, 6).alias("cosine"))


SIMILARITY_SQL = """
WITH f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS u FROM embeddings GROUP BY 1)
SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], u) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(u, u)), 6) AS cosine FROM embeddings e JOIN f ON e.label = f.label
"""


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("event_type").agg(F.count("k").alias("with_k"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


JSON_SQL = """
WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, count(k) AS with_k, min(k) AS least, max(k) AS most, sum(k)::BIGINT AS total FROM e GROUP BY 1
"""


def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return p.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.size(F.split(path, "/")).cast("long").alias("depth"),
        F.upper(F.substring(host, 1, 3)).alias("code"),
        F.length("html").cast("long").alias("n_chars"),
        F.substring(F.sha2(F.concat_ws("|", host, path), 256), 1, 16).alias("stable_id"),
        (~path.rlike(r"(^|/)\.\.(/|$)")).alias("safe"),
    )


STRING_SQL = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, length(html) AS n_chars FROM pages)
SELECT page_id, host, path, len(string_split(path, '/')) AS depth, upper(host[1:3]) AS code, n_chars, sha256(host || '|' || path)[1:16] AS stable_id, NOT regexp_matches(path, '(^|/)\.\.(/|$)') AS safe FROM p
"""


def recording_quality(spark, sf_dir):
    """Parts as recordings: size stands for the short edge, price for the duration. Any failure is UNSUITABLE, any warning LIMITED."""
    p = table(spark, sf_dir, "part").withColumns({"edge": F.col("p_size") * 30, "seconds": F.col("p_retailprice") / 20})
    listed = lambda *named: F.filter(F.array(*[F.when(c, n) for n, c in named]), lambda x: x.isNotNull())
    fails = listed(("low_resolution", F.col("edge") < 480), ("too_short", F.col("seconds") < 10))
    warns = listed(("modest_resolution", F.col("edge").between(480, 719)), ("vertical", F.col("p_partkey") % 9 == 0))
    p = p.withColumns({"fails": fails, "warns": warns})
    excellent = (F.col("edge") >= 1080) & (F.col("seconds") >= 60)
    level = F.when(F.size("fails") > 0, "UNSUITABLE").when(F.size("warns") > 0, "LIMITED").when(excellent, "EXCELLENT").otherwise("GOOD")
    return p.select("p_partkey", level.alias("level"), F.array_join(F.concat("fails", "warns"), ",").alias("codes"))


RECORDING_SQL = """
WITH p AS (SELECT p_partkey, p_size * 30 AS edge, p_retailprice / 20 AS seconds FROM part),
c AS (SELECT *, list_filter([CASE WHEN edge < 480 THEN 'low_resolution' END, CASE WHEN seconds < 10 THEN 'too_short' END], lambda x: x IS NOT NULL) AS f,
  list_filter([CASE WHEN edge BETWEEN 480 AND 719 THEN 'modest_resolution' END, CASE WHEN p_partkey % 9 = 0 THEN 'vertical' END], lambda x: x IS NOT NULL) AS w FROM p)
SELECT p_partkey, CASE WHEN len(f) > 0 THEN 'UNSUITABLE' WHEN len(w) > 0 THEN 'LIMITED' WHEN edge >= 1080 AND seconds >= 60 THEN 'EXCELLENT' ELSE 'GOOD' END AS level, array_to_string(list_concat(f, w), ',') AS codes FROM c
"""


def insight_rules(spark, sf_dir):
    """The first of the zone and distance rules that a player's movement meets, in priority order, four at most."""
    from ..operators.movement import movement_summary
    from .movement_queries import COURT, POLICY

    m = movement_summary(observations(spark, sf_dir), POLICY, COURT)
    k, t, b = F.col("kitchen_percent"), F.col("transition_percent"), F.col("baseline_percent")
    rules = (
        ("baseline_high", b >= 55), ("kitchen_high", k >= 55), ("transition_high", t >= 55), ("transition_low", t <= 20),
        ("balanced", (F.greatest(k, t, b) < 55) & (F.least(k, t, b) > 20)), ("short_distance", F.col("distance_feet") <= 100), ("measured", F.lit(True)),
    )
    names = F.slice(F.filter(F.array(*[F.when(c, n) for n, c in rules]), lambda x: x.isNotNull()), 1, 4)
    gate = H.ladder((F.col("observations") < 3, "INSUFFICIENT"), (F.col("unobserved_seconds") > F.col("observed_seconds") * 4, "MEASUREMENT_ONLY"), otherwise="CAUTIOUS")
    return m.select("player_id", gate.alias("gate"), F.array_join(names, ",").alias("insights"))


def _insight_sql() -> str:
    from .movement_queries import MOVEMENT_SQL

    return f"""
SELECT player_id, CASE WHEN observations < 3 THEN 'INSUFFICIENT' WHEN unobserved_seconds > observed_seconds * 4 THEN 'MEASUREMENT_ONLY' ELSE 'CAUTIOUS' END AS gate,
  array_to_string(list_filter([CASE WHEN baseline_percent >= 55 THEN 'baseline_high' END, CASE WHEN kitchen_percent >= 55 THEN 'kitchen_high' END, CASE WHEN transition_percent >= 55 THEN 'transition_high' END,
    CASE WHEN transition_percent <= 20 THEN 'transition_low' END,
    CASE WHEN greatest(kitchen_percent, transition_percent, baseline_percent) < 55 AND least(kitchen_percent, transition_percent, baseline_percent) > 20 THEN 'balanced' END,
    CASE WHEN distance_feet <= 100 THEN 'short_distance' END, 'measured'], lambda x: x IS NOT NULL)[1:4], ',') AS insights
FROM ({MOVEMENT_SQL}) m
"""


def readiness_verdict(spark, sf_dir):
    """One row: evidence counts against their minima and the verdict they allow."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = d.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("lang").alias("langs"))
    b = l.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("positive"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct_ids"))
    row = a.crossJoin(b)  # two rows of one
    failed = F.filter(F.array(F.when(F.col("samples") < 20, "samples"), F.when(F.col("reviewed") < 5, "reviewed"), F.when(F.col("positive") < 10, "positive"), F.when(F.col("langs") < 2, "langs")), lambda x: x.isNotNull())
    verdict = F.when(F.col("ids") != F.col("distinct_ids"), "NOT_READY").when(F.size(failed) > 0, "COLLECTING_EVIDENCE").otherwise("READY_FOR_POLICY_REVIEW")
    return row.select("samples", "reviewed", "positive", "langs", F.array_join(failed, ",").alias("failed"), verdict.alias("verdict"))


READINESS_SQL = """
WITH r AS (SELECT (SELECT count(*) FROM documents) AS samples, (SELECT count(*) FROM labels) AS reviewed, (SELECT count(*) FROM labels WHERE toxic = 1) AS positive, (SELECT count(DISTINCT lang) FROM documents) AS langs,
  (SELECT count(doc_id) = count(DISTINCT doc_id) FROM labels) AS unique_ids),
f AS (SELECT *, list_filter([CASE WHEN samples < 20 THEN 'samples' END, CASE WHEN reviewed < 5 THEN 'reviewed' END, CASE WHEN positive < 10 THEN 'positive' END, CASE WHEN langs < 2 THEN 'langs' END], lambda x: x IS NOT NULL) AS failed FROM r)
SELECT samples, reviewed, positive, langs, array_to_string(failed, ',') AS failed, CASE WHEN NOT unique_ids THEN 'NOT_READY' WHEN len(failed) > 0 THEN 'COLLECTING_EVIDENCE' ELSE 'READY_FOR_POLICY_REVIEW' END AS verdict FROM f
"""

_ALL = (
    (contribution_ladder, LADDER_SQL), (chronological_split, SPLIT_SQL), (ratio_of_sums_trend, TREND_SQL), (most_common_category, COMMON_SQL), (history_counts, COUNTS_SQL), (page_newest_first, PAGE_SQL),
    (duplicate_by_checksum, CHECKSUM_SQL), (confusion_matrix, CONFUSION_SQL), (dataset_balance, BALANCE_SQL), (reconcile_full_outer, RECONCILE_SQL), (anti_semi_checks, ANTI_SQL), (set_operations, SETS_SQL),
    (transition_audit, AUDIT_SQL), (current_version, VERSION_SQL), (similarity_pairs, SIMILARITY_SQL), (json_props, JSON_SQL), (string_functions, STRING_SQL), (recording_quality, RECORDING_SQL),
    (insight_rules, _insight_sql()), (readiness_verdict, READINESS_SQL),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL}
