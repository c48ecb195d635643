import json

from strideframe.streaming import activity as A


def lines(rows):
    return "\n".join(json.dumps({"analysis_id": a, "track_id": t, "timestamp_seconds": s, "confidence": 0.5}) for a, t, s in rows)


def drained(spark, df, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_windows_and_sessions_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "a.json").write_text(lines([("x", 1, 0.0), ("x", 1, 1.0), ("x", 2, 2.9), ("x", 1, 3.5), ("x", 1, 100.0)]))
    got = drained(spark, A.tumbling(A.read_stream(spark, str(tmp_path)), "3 seconds", "5 seconds"), "tumbling")
    assert sorted((r.observations, r.tracks) for r in got) == [(1, 1), (3, 2)]
    got = drained(spark, A.track_sessions(A.read_stream(spark, str(tmp_path)), "2 seconds", "5 seconds"), "track_sessions")
    assert sorted((r.track_id, r.observations) for r in got) == [(1, 1), (1, 2), (2, 1)]
