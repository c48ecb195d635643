"""Artifacts on real files: listings, detections, labels, manifests and the sinks."""

import hashlib
import json

import pytest

from strideframe.sources import artifacts as A


@pytest.fixture
def root(tmp_path):
    files = {
        "a1/job.json": '{"analysis_id": "a1", "status": "completed", "current_stage": "analyzed"}',
        "a1/tracking/tracking.json": '{"selected_player_track_id": 7, "selected_player_source_track_ids": [7, 8]}',
        "a1/calibrations/z/calibration.json": "{}",
        "a1/calibrations/b/calibration.json": "{}",
        "a2/job.json": "{broken",
        "a2/frames/frame.v3.png": "x",
        "a3/notes.txt": "nothing",
    }
    for name, text in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "root")


def test_listing_and_inventory(spark, root):
    rows = {(r.folder, r.key): r for r in A.inventory(A.listing(spark, root, content=True)).collect()}
    assert len(rows) == 5 and ("a1", "job.json") not in rows
    frame = rows["a2", "frames/frame.v3.png"]
    assert (frame.kind, frame.content_type, frame.schema_version, frame.size_bytes) == ("sampled_frame", "image/png", 3, 1)
    assert frame.sha256 == hashlib.sha256(b"x").hexdigest()
    assert (rows["a3", "notes.txt"].kind, rows["a3", "notes.txt"].schema_version) == ("metadata", None)


def test_folders(spark, root):
    files = A.listing(spark, root, content=True)
    got = {r.folder: (r.classification, r.artifacts) for r in A.legacy_inventory(files).collect()}
    assert got == {"a1": ("valuable", 3), "a2": ("malformed", 1), "a3": ("no_job", 1)}
    assert [tuple(r) for r in A.first_match(files, "calibrations/*/calibration.json").collect()] == [("a1", "calibrations/b/calibration.json")]
    assert [tuple(r) for r in A.player_selection(files).collect()] == [("a1", None, 7, [7, 8])]


def test_detections(spark, tmp_path):
    line = lambda frame, track, x2=2.0: json.dumps({"frame_index": frame, "track_id": track, "confidence": 0.5, "bounding_box": {"x1": 1.0, "y1": 1.0, "x2": x2, "y2": 3.0}})
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join([line(1, 9), "", line(0, 2), line(1, 4)]))
    got = {r.frame_index: [d.track_id for d in r.detections] for r in A.read_detections(spark, str(good)).collect()}
    assert got == {0: [2], 1: [4, 9]}
    for bad in (line(-1, 1), line(1, 1, x2=1.0), '{"frame_index": 1}', "{"):
        path = tmp_path / f"{abs(hash(bad))}.jsonl"
        path.write_text(line(0, 2) + "\n" + bad)
        with pytest.raises(Exception):  # noqa: B017  Spark's own kinds of errors
            A.read_detections(spark, str(path)).collect()


def test_labels(spark, tmp_path):
    for name, frames in {"up": [0, 3, 4], "same": [1, 1], "below": [-1, 2]}.items():
        (tmp_path / name).write_text("\n".join(json.dumps({"frame_index": f}) for f in frames))
    (tmp_path / "bad").write_text('{"frame_index": 1}\n{broken')
    got = {r.clip_id: (r.labels, r.problem) for r in A.label_problems(A.read_labels(spark, str(tmp_path))).collect()}
    assert got == {"up": (3, None), "same": (2, "NOT_ORDERED"), "below": (2, "NOT_ORDERED"), "bad": (2, "INVALID")}


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text('{\n "samples": [{"id": "s1"}]\n}')
    (row,) = A.read_manifest(spark, str(path), "samples array<struct<id: string>>").collect()
    assert row.manifest.samples[0].id == "s1" and row.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    path.write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        A.read_manifest(spark, str(path), "samples array<struct<id: string>>").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", None)], "metric string, value double")
    A.write_markdown(df, str(tmp_path / "md"), "Report", "metric", "value")
    (text,) = (p.read_text() for p in (tmp_path / "md").glob("part-*"))
    assert text.splitlines() == ["# Report", "", "| metric | value |", "| --- | --- |", "| a | not available |", "| b | 2.0 |"]
    A.write_report(df.limit(1), str(tmp_path / "js"))
    (text,) = (p.read_text() for p in (tmp_path / "js").glob("part-*"))
    assert json.loads(text) == {"metric": "b", "value": 2.0} and "\n" in text.strip()
    target = str(tmp_path / "out")
    A.publish(df, target)
    with pytest.raises(FileExistsError):
        A.publish(df, target)
    A.publish(df.where("metric = 'a'"), target, replace=True)
    assert spark.read.json(target).count() == 1
    failing = df.selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):  # noqa: B017
        A.publish(failing, str(tmp_path / "never"))
    assert not list(tmp_path.glob("never*"))
