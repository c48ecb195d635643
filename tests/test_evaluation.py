"""Canonical documents against plain recursion, and the small cases of the evaluation."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from strideframe.functions import documents as D
from strideframe.operators import evaluation as E


def nested(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind < 5:
        return [None, rng.randrange(-9, 9), rng.random() * 1e6, rng.choice(["", "é\"\\", "plain", " "]), rng.random() < 0.5][kind]
    if kind == 5:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(3))]
    keys = ["a", "b", "ä", "API-Key", "my_token", "Cookies", "c d", "z"]
    return {k: nested(rng, depth + 1) for k in rng.sample(keys, rng.randrange(5))}


def secret(key):
    return any(p in key.casefold().replace("-", "_") for p in ("api_key", "authorization", "cookie", "credential", "password", "private_key", "secret", "token"))


def clean(v):
    if isinstance(v, dict):
        return {k: clean(x) for k, x in v.items() if not secret(k)}
    return [clean(x) for x in v] if isinstance(v, list) else v


def over(a, b):
    out = dict(a)
    for k, v in b.items():
        if not secret(k):
            out[k] = over(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def test_documents_equal_plain_recursion(spark):
    rng = random.Random(9)
    top = lambda: {k: nested(rng) for k in rng.sample(["a", "b", "detector", "Secret", "z"], 3)}
    pairs = [(top(), top()) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b, ensure_ascii=i % 2 == 0)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", D.canonical("a", "b").alias("t")).withColumn("f", D.fingerprint(F.col("t"))).collect()
    for r in rows:
        want = json.dumps(clean(over(*pairs[r.i])), sort_keys=True, separators=(",", ":"))
        assert (r.t, r.f) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_documents_of_other_kinds(spark):
    df = spark.createDataFrame([(0, None, None), (1, "", '{"a":1}'), (2, "[1]", None), (3, '{"a":NaN}', None)], "i int, a string, b string")
    assert {r.i: r.t for r in df.select("i", D.canonical("a", "b").alias("t")).collect()} == {0: "{}", 1: '{"a":1}', 2: None, 3: None}
    changes = ['{"frames":1,"detector":{"model":1,"odd":2}}', '{"x":1,"detector":[1]}', None, '{"detector":null}']
    rows = spark.createDataFrame(list(enumerate(changes)), "i int, c string").select("i", D.unknown_keys(F.col("c"), ["frames"], {"detector": ["model"]}).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {0: ["detector.odd"], 1: ["detector", "x"], 2: [], 3: []}


def sample(**more):
    names = [c.split()[0] for c in E.SAMPLE.replace("struct<", "struct").split(", ")]
    return tuple(more.get(n) for n in names)


def test_disagreements_and_summary_of_small_samples(spark):
    yes = ("YES",) * 6
    rows = [
        sample(sample_id="s1", status="REVIEWED", system_quality="GOOD", expected_quality="BAD", quality_delta=1, system_gate="NORMAL", expected_gate="INSUFFICIENT_EVIDENCE", reason_codes=["r1", "r2"], artifacts=[("tracking", "OLD")],
               artifact_readiness="READY", identity_reviewed=False, mappings=[("c1", "SPECTATOR", None, "NO"), ("c2", "COURT_PLAYER", "p", "YES")], tracking=[(None, "p1", 0.5, 12.0, "YES", "BROKEN")],
               insights=[("i1", "CAUTIOUS", "NO", *yes[:4], "NO")], active_play=[(None,)], incomplete=["recording", "insight"]),
        sample(sample_id="s0", system_gate=None, expected_gate="NORMAL", quality_delta=-1, errors=["e"]),
    ]
    df = spark.createDataFrame(rows, E.SAMPLE)
    got = {(r.sample_id, r.category, r.output, r.expectation) for r in E.disagreements(df).collect()}
    assert got == {
        ("s1", "RECORDING_ASSESSMENT", "GOOD", "BAD"), ("s1", "INSIGHT_GATING", "NORMAL", "INSUFFICIENT_EVIDENCE"), ("s1", "CANDIDATE_ASSOCIATION", "c1", "SPECTATOR:no-player"), ("s1", "TRACKING_CONTINUITY", "no candidate", "p1 from 0.5-12s"),
        ("s1", "MEASUREMENT", "i1:measurement_correct", "YES"), ("s1", "WORDING", "i1:wording_understandable", "YES"), ("s1", "INCOMPLETE_ANNOTATION", "REVIEWED", "Complete independent review"),
    }
    assert {(r.kind, r.reason, r.n) for r in E.policy_errors(df).collect()} == {("quality_overestimation", "r1", 1), ("quality_overestimation", "r2", 1), ("false_acceptance", "r1", 1), ("false_acceptance", "r2", 1), ("quality_underestimation", "missing_assessment", 1)}
    assert [(r.reason, r.n, r.place) for r in E.failure_reasons(df).orderBy("place").collect()] == [("e", 1, 1), ("r1", 1, 2), ("r2", 1, 3)]
    summary = {r.category: (r.n, r.first_ids, r.availability) for r in E.summary(df).collect()}
    assert list(sorted(summary)) == sorted(E.CATEGORIES)
    assert summary["player_identity"] == (1, ["s0"], "AVAILABLE") and summary["active_play_boundary"] == (1, ["s1"], "AVAILABLE") and summary["tracking_continuity"] == (1, ["s0"], "AVAILABLE")
    assert summary["confidence"] == (None, [], "NOT_REVIEWED") and summary["wording"][0] == 1 and summary["artifact_compatibility"] == (1, ["s0"], "AVAILABLE")
    unplayed = {r.category: r.n for r in E.summary(df.where("sample_id = 's0'")).collect()}
    assert unplayed["active_play_state"] is None and unplayed["measurement"] == 0


def test_the_summary_keeps_the_first_ten_of_many(spark):
    df = spark.createDataFrame([sample(sample_id=f"s{i:04d}", artifact_readiness="MISSING") for i in range(500)], E.SAMPLE).repartition(7)
    row = {r.category: r for r in E.summary(df).collect()}["artifact_compatibility"]
    assert row.n == 500 and row.first_ids == [f"s{i:04d}" for i in range(10)]


def test_outcomes_and_counts_keep_missing_apart_from_zero(spark):
    names = "k int, system_quality string, verdict string, label string, system_gate string, expected_gate string, warnings array<string>, errors array<string>"
    rows = [(0, "GOOD", "LIMITED", "EXCELLENT", "NORMAL", "NORMAL", [], None), (1, "UNSUITABLE", "NOT_REVIEWED", "EXCELLENT", None, "CAUTIOUS", ["w"], []), (2, None, None, "GOOD", None, "NOT_REVIEWED", None, None)]
    got = {r.k: (r.expected_quality, r.quality_delta, r.exact, r.acceptable, r.gate_agrees, r.outcome) for r in E.outcomes(spark.createDataFrame(rows, names)).collect()}
    assert got == {0: ("LIMITED", 1, False, True, True, "EVALUATED"), 1: ("EXCELLENT", -3, False, False, None, "PARTIAL"), 2: ("GOOD", None, None, None, None, "FAILED")}
    mappings = "g int, n int, m array<struct<role:string>>"
    df = spark.createDataFrame([(1, None, [("SPECTATOR",), ("DUPLICATE",)]), (1, 0, [("SPECTATOR",)]), (2, None, []), (2, None, None), (3, 0, None)], mappings)
    sums = df.groupBy("g").agg(E.optional_count(F.col("n")).alias("a"), F.sum(E.count_or_role(F.col("n"), "m", "SPECTATOR")).alias("b")).collect()
    assert {r.g: (r.a, r.b) for r in sums} == {1: (0, 1), 2: (None, None), 3: (0, 0)}
    rate = E.duration_rate(F.lit(6.25), F.lit(0.0), F.lit(2), F.lit(True))
    raw = E.raw_metric(F.lit(3), F.lit(2), 5)
    row = spark.range(1).select(rate["percent"].alias("p"), rate["text"].alias("t"), raw["note"].alias("n")).first()
    assert (row.p, row.t) == (None, "6.250/0.000s (not available; 2 intervals) — provisional") and row.n.endswith("Coverage is provisional below 5 reviewed samples.")
