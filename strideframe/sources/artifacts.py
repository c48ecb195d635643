"""Folders of artifacts: inventories, the state of referenced files, detections, labels and reports.

A listing has a row per file: `folder` (first level below the root), `key` (path below the folder), `size_bytes`, `modified` and, where asked for, `content`
(text) and `sha256`. The checks take such rows from any source and none fails a job, but for readers that are told to raise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.invariants import box_problems

c = F.col

#: Kinds of artifacts by their first folder, content types by extension.
KINDS = {
    "uploads": "source_video", "frames": "sampled_frame", "calibrations": "calibration", "tracking": "tracking", "analytics": "analytics", "active_play": "active_play", "ball": "ball_tracking", "stages": "stage_evidence",
}
CONTENT_TYPES = {"json": "application/json", "mp4": "video/mp4", "mov": "video/quicktime", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv"}
DETECTION = "frame_index long, track_id long, bounding_box struct<x1: double, y1: double, x2: double, y2: double>, confidence double"


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """All files below `root`; contents are read, and hashed, only if asked for. Hidden files are none."""
    fs, at = _filesystem(spark, root)
    base = fs.makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substr("path", F.lit(len(base) + 2))
    columns = [F.substring_index(below, "/", 1).alias("folder"), F.regexp_replace(below, "^[^/]*/?", "").alias("key"), c("length").alias("size_bytes"), c("modificationTime").alias("modified")]
    if content:
        columns += [F.expr("try_validate_utf8(CAST(content AS STRING))").alias("content"), F.sha2("content", 256).alias("sha256")]
    return files.select(*columns)


def inventory(files: DataFrame) -> DataFrame:
    """Artifacts of all folders with their kind, content type and schema version; job.json is none."""
    first = F.substring_index("key", "/", 1)
    name = F.substring_index("key", "/", -1)
    lookup = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    kind = F.coalesce(F.try_element_at(lookup(KINDS), first), F.lit("metadata"))
    media = F.coalesce(F.try_element_at(lookup(CONTENT_TYPES), F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))
    version = F.nullif(F.regexp_extract(name, r"\.v([1-9][0-9]*)\.", 1), F.lit("")).cast("long")
    return files.where(name != "job.json").withColumns({"kind": kind, "content_type": media, "schema_version": version})


def is_document(text: str | Column, required: tuple[str, ...] = ()) -> Column:
    """Whether a text is a JSON object in which the required fields are not null."""
    text = c(text) if isinstance(text, str) else text
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    for field in required:
        ok &= F.get_json_object(text, f"$.{field}").isNotNull()
    return ok


def readiness(references: DataFrame, files: DataFrame, required: tuple[str, ...] = (), version_key: str = "version", optional: bool = False) -> DataFrame:
    """References (folder, key, label, expected_version) with the state of their file.

    NOT_REFERENCED without a folder, MISSING without a file, INVALID if it is no document, STALE if its version is not the expected one (null: any will do),
    else AVAILABLE; `compatibility` and `note` (null where nothing is to be said) follow from that.
    """
    found = files.select("folder", "key", c("content").alias("__content"), F.lit(True).alias("__found"))
    version = F.coalesce(F.get_json_object("__content", f"$.{version_key}"), F.lit("missing"))
    status = (
        F.when(c("folder").isNull(), "NOT_REFERENCED").when(c("__found").isNull(), "MISSING").when(~is_document("__content", required), "INVALID")
        .when(c("expected_version").isNotNull() & (version != c("expected_version")), "STALE").otherwise("AVAILABLE")
    )
    rows = references.join(found, ["folder", "key"], "left").withColumn("status", status)
    compatibility = F.when(c("status").isin("NOT_REFERENCED", "MISSING"), "MISSING").when(c("status") == "INVALID", "INCOMPATIBLE").when(c("status") == "STALE", "LEGACY_COMPATIBLE").otherwise("READY")
    note = F.when((c("status") == "MISSING") & F.lit(not optional), F.concat(F.lit("missing_artifact:"), "label"))
    note = note.when(c("status") == "INVALID", F.concat(F.lit("invalid_artifact:"), "label")).when(c("status") == "STALE", F.concat(F.lit("stale_artifact:"), "label"))
    return rows.withColumns({"compatibility": compatibility, "note": note, "version": F.when(c("status").isin("STALE", "AVAILABLE"), version)}).drop("__content", "__found")


def source_status(content: str = "content", required: tuple[str, ...] = ()) -> Column:
    """MISSING, INVALID or CURRENT, for a content that is null without its file."""
    return F.when(c(content).isNull(), "MISSING").when(~is_document(content, required), "INVALID").otherwise("CURRENT")


def first_match(files: DataFrame, glob: str) -> DataFrame:
    """The first file by name of each folder that matches; a star stands for a part without a slash."""
    pattern = "^" + r"[^/]+".join(part.replace(".", r"\.") for part in glob.split("*")) + "$"
    return files.where(c("key").rlike(pattern)).groupBy("folder").agg(F.min("key").alias("key"))


def legacy_inventory(files: DataFrame) -> DataFrame:
    """Folders with files, bytes and class: valuable (completed and analyzed), incomplete, malformed, or no_job."""
    job = F.when(c("key") == "job.json", c("content"))
    about = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.count_if(c("key") == "job.json").alias("jobs"), F.max(job).alias("job"))
    valid = is_document("job", ("analysis_id", "status", "current_stage"))
    status, stage = F.get_json_object("job", "$.status"), F.get_json_object("job", "$.current_stage")
    kind = F.when(c("jobs") == 0, "no_job").when(~valid, "malformed").when((status == "completed") & (stage == "analyzed"), "valuable").otherwise("incomplete")
    return about.select("folder", kind.alias("classification"), F.when(valid, status).alias("status"), F.when(valid, stage).alias("stage"), (c("files") - F.least("jobs", F.lit(1))).alias("artifacts"), "size_bytes")


def player_selection(files: DataFrame) -> DataFrame:
    """What tracking.json says is selected: of folders with a candidate or a track. A field of another type is null, a list with anything but integers is empty."""
    doc = F.try_parse_json("content")
    docs = files.where((c("key") == "tracking/tracking.json") & is_document("content")).withColumn("__doc", doc)
    field = lambda name: F.try_variant_get("__doc", f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(field(name))
    given = lambda name: F.coalesce(kind(name) != "VOID", F.lit(False))
    candidate, track, ids = (f"selected_player_{x}" for x in ("candidate_id", "track_id", "source_track_ids"))
    return docs.where(given(candidate) | given(track)).select(
        "folder",
        F.when(kind(candidate) == "STRING", F.try_variant_get("__doc", f"$.{candidate}", "string")).alias("candidate_id"),
        F.when(kind(track) == "BIGINT", F.try_variant_get("__doc", f"$.{track}", "bigint")).alias("track_id"),
        F.when(kind(ids) == "ARRAY<BIGINT>", F.try_variant_get("__doc", f"$.{ids}", "array<bigint>")).otherwise(F.expr("CAST(array() AS array<bigint>)")).alias("source_track_ids"),
    )


def fingerprints(files: DataFrame, keys: dict[str, str], versioned: str) -> DataFrame:
    """Per folder the hash of each of the files `keys` (name to key), null without the file, and the schema_version that the file `versioned` states (1 if it does not)."""
    hashes = [F.max(F.when(c("key") == key, c("sha256"))).alias(name) for name, key in keys.items()]
    stated = F.get_json_object("content", "$.schema_version").cast("long")
    version = F.max(F.when(c("key") == keys[versioned], F.coalesce(stated, F.lit(1)))).alias("schema_version")
    return files.where(c("key").isin(list(keys.values()))).groupBy("folder").agg(*hashes, version)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON manifests with the hash of their bytes; a text that does not fit the schema fails."""
    text = c("content").cast("string")
    return spark.read.format("binaryFile").load(path).select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("manifest"), F.sha2("content", 256).alias("sha256"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of JSON lines by frame, ascending by track; a bad line, a negative frame or a flat box fails the job."""
    rows = spark.read.schema(DETECTION).option("mode", "FAILFAST").json(path)
    box = [F.col(f"bounding_box.{side}") for side in ("x1", "y1", "x2", "y2")]
    rows = rows.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box)))
    bad = F.coalesce(c("frame_index") < 0, F.lit(True)) | c("track_id").isNull() | c("confidence").isNull() | (F.size(box_problems()) > 0)
    frame = F.when(bad, F.raise_error(F.concat(F.lit("invalid detection: "), F.to_json(F.struct("frame_index", "track_id", "bounding_box"))))).otherwise(c("frame_index"))
    return rows.select(frame.alias("frame_index"), F.struct("track_id", "bounding_box", "confidence").alias("detection")).groupBy("frame_index").agg(
        F.sort_array(F.collect_list("detection")).alias("detections")  # a frame has a few people
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of JSON lines with the file they are from and `line`, which ascends in it; a bad line has no frame_index."""
    rows = spark.read.schema("frame_index long, _corrupt_record string").json(path)
    return rows.select("frame_index", c("_metadata.file_name").alias("clip_id"), F.struct(c("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))


def label_problems(labels: DataFrame) -> DataFrame:
    """Clips with the number of their labels and INVALID (a label without a frame), NOT_ORDERED (frames that do not ascend from 0), or null."""
    before = F.lag("frame_index", 1, -1).over(Window.partitionBy("clip_id").orderBy("line"))
    rows = labels.withColumn("__late", c("frame_index") <= before)
    about = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(c("frame_index").isNull()).alias("bad"), F.count_if("__late").alias("late"))
    return about.select("clip_id", "labels", F.when(c("bad") > 0, "INVALID").when(c("late") > 0, "NOT_ORDERED").alias("problem"))


def dataset_problems(clips: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """Clips (clip_id, video, video_sha256) with the first thing against them, or null, and their labels.

    files: (video, sha256) below the root; labels: what label_problems() gives.
    """
    rows = clips.join(files.select("video", "sha256"), "video", "left").join(labels.select("clip_id", "labels", c("problem").alias("label_problem")), "clip_id", "left")
    outside = c("video").startswith("/") | c("video").rlike(r"(^|/)\.\.(/|$)")
    problem = (
        F.when(outside, "OUTSIDE_ROOT").when(c("sha256").isNull(), "MISSING_VIDEO").when(c("sha256") != c("video_sha256"), "OTHER_VIDEO")
        .when(c("labels").isNull(), "NO_LABELS").otherwise(c("label_problem"))
    )
    return rows.select("clip_id", F.coalesce("labels", F.lit(0)).alias("labels"), problem.alias("problem"))


def write_report(df: DataFrame, path: str) -> None:
    """Few rows, such as metrics, as indented JSON texts in one file; a path that exists is an error."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"pretty": "true"})).coalesce(1).write.mode("error").text(path)


def write_markdown(metrics: DataFrame, path: str, title: str, key: str, value: str) -> None:
    """A table of few metrics, ascending by key; a path that exists is an error."""
    head = metrics.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, f"| {key} | {value} |"), (3, "| --- | --- |")], "part int, line string")
    cell = lambda name: F.coalesce(c(name).cast("string"), F.lit("not available"))
    body = metrics.select(F.lit(4).alias("part"), F.concat(F.lit("| "), cell(key), F.lit(" | "), cell(value), F.lit(" |")).alias("line"))
    head.union(body).coalesce(1).sortWithinPartitions("part", "line").select("line").write.mode("error").text(path)


def publish(df: DataFrame, path: str, replace: bool = False) -> None:
    """JSON lines that appear under `path` whole or not at all: written beside it, then renamed.

    Without `replace` a path that exists is an error. With it the old folder is put aside before the renaming, goes after it, and comes back if the renaming fails.
    """
    fs, at = _filesystem(df.sparkSession, path)
    mark = uuid.uuid4().hex
    _, partial = _filesystem(df.sparkSession, f"{path}.partial-{mark}")
    _, aside = _filesystem(df.sparkSession, f"{path}.before-{mark}")
    if fs.exists(at) and not replace:
        raise FileExistsError(path)
    try:
        df.write.json(partial.toString())
        held = replace and fs.exists(at)
        if held and not fs.rename(at, aside):
            raise OSError(f"cannot put {path} aside")
        if not fs.rename(partial, at):
            if held:
                fs.rename(aside, at)
            raise OSError(f"cannot rename to {path}")
        fs.delete(aside, True)
    finally:
        fs.delete(partial, True)
