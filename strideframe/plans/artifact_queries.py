"""Queries over artifacts and dashboards, with the DuckDB statements that check them. Orders stand for folders; their files follow from integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..session import table
from ..sources import artifacts as A

#: The files of folder k, n from 0 to 4, in both dialects.
_FILE = {
    "key": "CASE n WHEN 0 THEN 'job.json' WHEN 1 THEN 'tracking/tracking.json' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'calibrations/b1/calibration.json' ELSE 'calibrations/a/calibration.json' END "
    "WHEN 3 THEN 'calibrations/b0/calibration.json' ELSE CASE k % 4 WHEN 0 THEN 'frames/f.v2.PNG' WHEN 1 THEN 'summary.v12.json' WHEN 2 THEN 'ball/path.v0.jsonl' ELSE 'uploads/clip.mp4' END END",
    "size_bytes": "(k * 7 + n * 13) % 1000",
    "content": "CASE n WHEN 0 THEN CASE k % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"analysis_id\": \"x\", \"status\": \"failed\", \"current_stage\": \"analyzed\"}' WHEN 2 THEN '{\"status\": \"completed\"}' "
    "ELSE '{\"analysis_id\": \"x\", \"status\": \"completed\", \"current_stage\": \"analyzed\"}' END "
    "WHEN 1 THEN CASE k % 6 WHEN 0 THEN '[1]' WHEN 1 THEN '{\"version\": \"1\", \"selected_player_track_id\": \"7\"}' "
    "WHEN 2 THEN '{\"version\": \"2\", \"selected_player_track_id\": 7, \"selected_player_source_track_ids\": [7, 8]}' "
    "WHEN 3 THEN '{\"version\": \"2\", \"selected_player_candidate_id\": \"c1\", \"selected_player_source_track_ids\": [7, \"8\"]}' ELSE '{\"version\": \"2\"}' END ELSE '{\"schema_version\": 3}' END",
}


def _files(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "explode(sequence(0, 4)) AS n").where("(k + n) % 3 > 0")
    return rows.select(F.col("k").alias("folder"), *[F.expr(sql).alias(name) for name, sql in _FILE.items()]).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


_FILES = f"""
fi AS (SELECT k AS folder, {", ".join(f"{sql} AS {name}" for name, sql in _FILE.items())} FROM (SELECT o_orderkey AS k, unnest(range(5)) AS n FROM orders) WHERE (k + n) % 3 > 0)"""


def artifact_inventory(spark, sf_dir):
    """Files with their kind, content type and schema version."""
    return A.inventory(_files(spark, sf_dir)).select("folder", "key", "kind", "content_type", "schema_version")


INVENTORY_SQL = f"""
WITH {_FILES}
SELECT folder, key, CASE split_part(key, '/', 1) WHEN 'tracking' THEN 'tracking' WHEN 'calibrations' THEN 'calibration' WHEN 'frames' THEN 'sampled_frame' WHEN 'ball' THEN 'ball_tracking' WHEN 'uploads' THEN 'source_video' ELSE 'metadata' END AS kind,
  CASE WHEN key ILIKE '%.json' THEN 'application/json' WHEN key ILIKE '%.png' THEN 'image/png' WHEN key ILIKE '%.mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS content_type,
  nullif(regexp_extract(key, '[.]v([1-9][0-9]*)[.]', 1), '')::BIGINT AS schema_version FROM fi WHERE key <> 'job.json'
"""


def artifact_status(spark, sf_dir):
    """The state of each folder's tracking file; every eleventh folder refers to none."""
    refs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey END AS folder", "'tracking/tracking.json' AS key", "'tracking' AS label", "'2' AS expected_version")
    return A.readiness(refs, _files(spark, sf_dir)).select("k", "status", "compatibility", "version", "note")


STATUS_SQL = f"""
WITH {_FILES},
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey END AS folder FROM orders),
s AS (SELECT r.k, CASE WHEN r.folder IS NULL THEN 'NOT_REFERENCED' WHEN key IS NULL THEN 'MISSING' WHEN NOT json_valid(content) OR json_type(content) <> 'OBJECT' THEN 'INVALID'
    WHEN coalesce(json_extract_string(content, '$.version'), 'missing') <> '2' THEN 'STALE' ELSE 'AVAILABLE' END AS status, content FROM r LEFT JOIN fi ON fi.folder = r.folder AND key = 'tracking/tracking.json')
SELECT k, status, CASE status WHEN 'INVALID' THEN 'INCOMPATIBLE' WHEN 'STALE' THEN 'LEGACY_COMPATIBLE' WHEN 'AVAILABLE' THEN 'READY' ELSE 'MISSING' END AS compatibility,
  CASE WHEN status IN ('STALE', 'AVAILABLE') THEN coalesce(json_extract_string(content, '$.version'), 'missing') END AS version,
  CASE WHEN status IN ('MISSING', 'INVALID', 'STALE') THEN lower(status) || '_artifact:tracking' END AS note FROM s
"""


def first_calibration(spark, sf_dir):
    """The first calibration of each folder by name."""
    return A.first_match(_files(spark, sf_dir), "calibrations/*/calibration.json")


CALIBRATION_SQL = f"WITH {_FILES} SELECT folder, min(key) AS key FROM fi WHERE key LIKE 'calibrations/%' GROUP BY 1"


def legacy_folders(spark, sf_dir):
    """Classes of folders by their job file."""
    return D.legacy_summary(A.legacy_inventory(_files(spark, sf_dir)))


LEGACY_SQL = f"""
WITH {_FILES},
d AS (SELECT folder, count(*) AS files, sum(size_bytes) AS size_bytes, bool_or(key = 'job.json') AS has_job, max(CASE WHEN key = 'job.json' THEN content END) AS job FROM fi GROUP BY 1),
p AS (SELECT *, CASE WHEN json_valid(job) THEN job END AS j FROM d),
v AS (SELECT *, CASE WHEN NOT has_job THEN 'no_job' WHEN j IS NULL OR j ->> '$.analysis_id' IS NULL OR j ->> '$.status' IS NULL OR j ->> '$.current_stage' IS NULL THEN 'malformed'
    WHEN j ->> '$.status' = 'completed' AND j ->> '$.current_stage' = 'analyzed' THEN 'valuable' ELSE 'incomplete' END AS classification FROM p)
SELECT classification, count(*) AS folders, sum(files - has_job::INTEGER)::BIGINT AS artifacts, sum(size_bytes)::BIGINT AS size_bytes FROM v GROUP BY 1
"""


def selected_players(spark, sf_dir):
    """The selections that tracking files state, fields of other types left out."""
    out = A.player_selection(_files(spark, sf_dir))
    return out.select("folder", "candidate_id", "track_id", F.array_join(F.col("source_track_ids").cast("array<string>"), ",").alias("source_track_ids"))


SELECTION_SQL = f"""
WITH {_FILES}, t AS (SELECT folder, content AS j FROM fi WHERE key = 'tracking/tracking.json' AND json_type(content) = 'OBJECT'),
k AS (SELECT folder, j, json_type(j, '$.selected_player_candidate_id') AS ct, json_type(j, '$.selected_player_track_id') AS tt FROM t)
SELECT folder, CASE WHEN ct = 'VARCHAR' THEN j ->> '$.selected_player_candidate_id' END AS candidate_id, CASE WHEN tt IN ('UBIGINT', 'BIGINT') THEN (j ->> '$.selected_player_track_id')::BIGINT END AS track_id,
  CASE WHEN folder % 6 = 2 THEN '7,8' ELSE '' END AS source_track_ids FROM k WHERE coalesce(ct, 'NULL') <> 'NULL' OR coalesce(tt, 'NULL') <> 'NULL'
"""


def source_states(spark, sf_dir):
    """Per folder the state of its job and tracking files, and of both."""
    files = _files(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS folder", "explode(array('job.json', 'tracking/tracking.json')) AS key")
    rows = asked.join(files, ["folder", "key"], "left").withColumn("status", A.source_status())
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("status")))
    return rows.groupBy("folder").agg(one("job.json").alias("job"), one("tracking/tracking.json").alias("tracking"), D.overall_status("status").alias("overall"))


STATES_SQL = f"""
WITH {_FILES}, a AS (SELECT o_orderkey AS folder, unnest(['job.json', 'tracking/tracking.json']) AS key FROM orders),
s AS (SELECT a.folder, a.key, CASE WHEN content IS NULL THEN 'MISSING' WHEN NOT json_valid(content) OR json_type(content) <> 'OBJECT' THEN 'INVALID' ELSE 'CURRENT' END AS st FROM a LEFT JOIN fi ON fi.folder = a.folder AND fi.key = a.key)
SELECT folder, max(st) FILTER (key = 'job.json') AS job, max(st) FILTER (key <> 'job.json') AS tracking,
  CASE WHEN bool_or(st = 'INVALID') THEN 'INVALID' WHEN bool_or(st = 'MISSING') THEN 'MISSING' ELSE 'CURRENT' END AS overall FROM s GROUP BY 1
"""

_TRIPLE = {"job": "job.json", "tracking": "tracking/tracking.json", "calibration": "calibrations/b0/calibration.json"}


def source_fingerprints(spark, sf_dir):
    """Hashes of three files of each folder, and the version that the calibration states."""
    return A.fingerprints(_files(spark, sf_dir), _TRIPLE, "calibration")


FINGERPRINT_SQL = f"""
WITH {_FILES}
SELECT folder, {", ".join(f"max(sha256(content)) FILTER (key = '{key}') AS {name}" for name, key in _TRIPLE.items())},
  max(coalesce((CASE WHEN json_valid(content) THEN content ->> '$.schema_version' END)::BIGINT, 1)) FILTER (key = '{_TRIPLE["calibration"]}') AS schema_version
FROM (SELECT folder, key, content FROM fi WHERE key IN {tuple(_TRIPLE.values())}) GROUP BY 1
"""


def clip_checks(spark, sf_dir):
    """Customers as clips whose orders are labels; a frame is a date in days since 1992, the lines go by order key."""
    orders = table(spark, sf_dir, "orders")
    labels = orders.selectExpr("o_custkey AS clip_id", "CASE WHEN o_orderkey % 97 > 0 THEN o_orderkey + CASE WHEN o_orderkey % 31 = 0 THEN -5000 ELSE 0 END END AS frame_index", "o_orderkey AS line")
    files = table(spark, sf_dir, "customer").where("c_custkey % 13 > 0").selectExpr("concat('v/', c_custkey) AS video", "CAST(c_custkey AS STRING) AS sha256")
    clips = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS clip_id", "concat(CASE WHEN c_custkey % 17 = 0 THEN '../v/' ELSE 'v/' END, c_custkey) AS video", "CAST(CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE c_custkey END AS STRING) AS video_sha256"
    )
    return A.dataset_problems(clips, files, A.label_problems(labels))


CLIP_SQL = """
WITH l AS (SELECT o_custkey AS clip_id, CASE WHEN o_orderkey % 97 > 0 THEN o_orderkey + CASE WHEN o_orderkey % 31 = 0 THEN -5000 ELSE 0 END END AS f, o_orderkey AS line FROM orders),
g AS (SELECT clip_id, f, f <= lag(f, 1, -1) OVER (PARTITION BY clip_id ORDER BY line) AS late FROM l),
a AS (SELECT clip_id, count(*) AS labels, bool_or(f IS NULL) AS bad, coalesce(bool_or(late), false) AS late FROM g GROUP BY 1)
SELECT c_custkey AS clip_id, coalesce(labels, 0) AS labels, CASE WHEN c_custkey % 17 = 0 THEN 'OUTSIDE_ROOT' WHEN c_custkey % 13 = 0 THEN 'MISSING_VIDEO' WHEN c_custkey % 19 = 0 THEN 'OTHER_VIDEO' WHEN labels IS NULL THEN 'NO_LABELS'
  WHEN bad THEN 'INVALID' WHEN late THEN 'NOT_ORDERED' END AS problem FROM customer LEFT JOIN a ON clip_id = c_custkey
"""


def dataset_overview(spark, sf_dir):
    """Orders as samples by split and state of review."""
    rows = table(spark, sf_dir, "orders").selectExpr("element_at(array('development', 'validation', 'holdout'), CAST(o_custkey % 3 + 1 AS INT)) AS split", "CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'partially_reviewed' ELSE 'not_reviewed' END AS review")
    return D.dataset_overview(rows, "split", "review")


OVERVIEW_SQL = """
SELECT count(*) AS samples, count(*) FILTER (o_custkey % 3 = 0) AS development, count(*) FILTER (o_custkey % 3 = 1) AS validation, count(*) FILTER (o_custkey % 3 = 2) AS holdout,
  count(*) FILTER (o_orderstatus = 'F') AS reviewed, count(*) FILTER (o_orderstatus = 'P') AS partially_reviewed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS not_reviewed FROM orders
"""


def readiness_classes(spark, sf_dir):
    """All classes of readiness with the orders in them; PARTIAL has none."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'LEGACY' WHEN 2 THEN 'INCOMPATIBLE' ELSE 'READY' END AS readiness")
    return D.class_counts(rows, "readiness", "o_orderkey")


CLASSES_SQL = """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'LEGACY' WHEN 2 THEN 'INCOMPATIBLE' ELSE 'READY' END AS readiness FROM orders)
SELECT d.readiness, count(o_orderkey) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last
FROM (SELECT unnest(['READY', 'PARTIAL', 'LEGACY', 'MISSING', 'INCOMPATIBLE']) AS readiness) d LEFT JOIN o USING (readiness) GROUP BY 1
"""


def observation_coverage(spark, sf_dir):
    """Line items as observed and total seconds, with coverage and the width of a bar."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_orderkey % 50 - 2 AS DOUBLE) AS observed", "CAST(l_partkey % 60 AS DOUBLE) AS total")
    percentage, uncertain = D.coverage("observed", "total")
    width = D.bar_width("observed", ("observed", "total"), F.col("l_linenumber") % 2 == 0)
    return rows.select("l_orderkey", "l_linenumber", percentage.alias("percentage"), uncertain.alias("uncertain"), width.alias("width"))


COVERAGE_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 50 - 2)::DOUBLE AS o, (l_partkey % 60)::DOUBLE AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o > 0 AND o <= t THEN o / t * 100 END AS percentage, CASE WHEN o > 0 AND o <= t THEN t - o END AS uncertain,
  greatest(CASE WHEN o > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END, least(100.0::DOUBLE, o / CASE WHEN l_linenumber % 2 = 0 THEN 100.0::DOUBLE ELSE greatest(o, t, pow(2.0::DOUBLE, -52)) * 1.1::DOUBLE END * 100)) AS width FROM r
"""


def completed_latest(spark, sf_dir):
    """Per customer the completed orders and the newest of them."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderdate", "CASE o_orderkey % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'LIMITED' ELSE 'PROCESSING' END AS status")
    return D.completed(rows, ["o_custkey"], "status", ["o_orderdate"], "o_orderkey")


COMPLETED_SQL = """
WITH o AS (SELECT *, o_orderkey % 4 < 2 AS done, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 < 2 ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
SELECT o_custkey, count(*) FILTER (done) AS completed, max(o_orderkey) FILTER (done AND place = 1) AS latest FROM o GROUP BY 1
"""


def duplicate_keys(spark, sf_dir):
    """Storage keys that several files have: parts by supplier."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat(l_partkey, '/', l_suppkey) AS storage_key", "CAST(l_quantity AS BIGINT) AS size_bytes")
    totals, repeated = D.storage_totals(rows, "storage_key", "size_bytes")
    return repeated.unionByName(totals.select(F.lit("total bytes").alias("storage_key"), F.col("bytes").alias("files")))


DUPLICATE_SQL = """
SELECT l_partkey || '/' || l_suppkey AS storage_key, count(*) AS files FROM lineitem GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT 'total bytes', sum(l_quantity::BIGINT)::BIGINT FROM lineitem
"""

QUERIES = {
    f.__name__: f
    for f in (
        artifact_inventory, artifact_status, first_calibration, legacy_folders, selected_players, source_states, source_fingerprints, clip_checks, dataset_overview, readiness_classes, observation_coverage, completed_latest, duplicate_keys,
    )
}
ORACLES = dict(
    zip(
        QUERIES,
        (
            INVENTORY_SQL, STATUS_SQL, CALIBRATION_SQL, LEGACY_SQL, SELECTION_SQL, STATES_SQL, FINGERPRINT_SQL, CLIP_SQL, OVERVIEW_SQL, CLASSES_SQL, COVERAGE_SQL, COMPLETED_SQL, DUPLICATE_SQL,
        ),
    )
)
