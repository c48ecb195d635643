"""Bad lines of observation files by their numbers, and files that are replaced."""

import json

import pytest

from strideframe.sources import artifacts as A
from strideframe.sources import observations as S


def line(frame, position=(1.0, 2.0), **more):
    return json.dumps({"analysis_id": "a", "frame_index": frame, "timestamp_seconds": frame / 30, "track_id": 1, "court_position": position, **more})


def test_bad_lines_have_their_numbers_in_files_that_are_read_in_parts(spark, tmp_path):
    rows = [line(i) for i in range(3000)]
    rows[17] = "{not json"
    rows[400] = ""
    rows[1500] = line(1500, (float("nan"), 1.0))
    rows[2201] = json.dumps({"track_id": 1, "court_position": [1, 2]})
    rows[2999] = line(2999, (1.0,))
    (tmp_path / "observations.jsonl").write_text("\n".join(rows) + "\n")
    for size in ("20000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r.line, r.problem) for r in S.bad_lines(spark, str(tmp_path)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [(18, "NOT_JSON"), (1501, "NOT_FINITE"), (2202, "NO_TIME"), (3000, "NOT_FINITE")]
    with pytest.raises(ValueError, match="observations.jsonl, line 18: NOT_JSON"):
        S.checked_observations(spark, str(tmp_path))
    (tmp_path / "observations.jsonl").write_text("\n".join(line(i) for i in range(5)) + "\n\n")
    assert S.checked_observations(spark, str(tmp_path)).count() == 5


def test_replacing_keeps_the_old_folder_until_the_new_one_stands(spark, tmp_path):
    target = str(tmp_path / "report")
    A.publish(spark.range(3), target)
    A.publish(spark.range(5), target, replace=True)
    assert spark.read.json(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["report"]
    with pytest.raises(Exception):
        A.publish(spark.range(2).selectExpr("raise_error('broken') AS id"), target, replace=True)
    assert spark.read.json(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["report"]
