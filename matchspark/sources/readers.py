"""Readers and writers of the domain files.

Parsing takes a DataFrame of JSON documents so it can be tested on any column;
each ``read_*`` is the file scan plus its parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.session import cut_lineage

# Fields of a moment in a job document, with their types and the columns they become.
MOMENT_FIELDS = {
    "id": ("STRING", "moment_id"), "startTime": ("DOUBLE", "start_ms"), "endTime": ("DOUBLE", "end_ms"), "eventType": ("STRING", "event_type"), "storyId": ("STRING", "story_id"),
    "storyPhase": ("STRING", "story_phase"), "keepDecision": ("STRING", "keep_decision"), "sourceImportanceScore": ("DOUBLE", "source_importance"), "hookScore": ("DOUBLE", "hook"),
    "flowScore": ("DOUBLE", "flow"), "visualClarity": ("DOUBLE", "visual_clarity"), "excitementScore": ("DOUBLE", "excitement"), "narrativeCompleteness": ("DOUBLE", "completeness"),
    "rejectReason": ("STRING", "reject_reason"), "isReplay": ("BOOLEAN", "is_replay"), "editOrder": ("INT", "edit_order"), "beatId": ("STRING", "beat_id"), "role": ("STRING", "role"),
    "transitionIn": ("STRING", "transition_in"), "playerHighlight": ("BOOLEAN", "player_highlight"), "tacticalDrawing": ("STRING", "tactical_drawing"), "transitionDuration": ("DOUBLE", "transition_ms"),
    "effect": ("STRING", "effect"), "playbackRate": ("DOUBLE", "playback_rate"), "freezeAtPhase": ("STRING", "freeze_at_phase"), "freezeDuration": ("DOUBLE", "freeze_ms"),
    "narrationDelay": ("DOUBLE", "narration_delay_ms"), "suppressPayoffCaption": ("BOOLEAN", "suppress_payoff_caption"), "identityLabel": ("STRING", "identity_label"),
    "analysisPurpose": ("STRING", "analysis_purpose"), "onScreenText": ("STRING", "screen_text"), "eventCallout": ("STRING", "event_callout"), "colorGrade": ("STRING", "color_grade"),
    "soundEffect": ("STRING", "sound_effect"), "importanceScore": ("DOUBLE", "importance"), "description": ("STRING", "description"), "confidence": ("DOUBLE", "confidence"),
    "ballVisible": ("BOOLEAN", "ball_visible"), "mainPlayerVisible": ("BOOLEAN", "player_visible"), "recommendedCrop": ("ARRAY<STRUCT<time: DOUBLE, x: DOUBLE, y: DOUBLE, confidence: DOUBLE>>", "recommended_crop"),
    "selectedForFinalVideo": ("BOOLEAN", "selected"), "commentary": ("STRING", "commentary"), "duplicateGroup": ("STRING", "duplicate_group"),
    "semanticVerified": ("BOOLEAN", "semantic_verified"), "actionComplete": ("BOOLEAN", "action_complete"), "trackingDecision": ("STRING", "tracking_decision"),
}
JOB = "id STRING, stage STRING, progress DOUBLE, moments ARRAY<STRUCT<" + ", ".join(f"{k}: {kind}" for k, (kind, _) in MOMENT_FIELDS.items()) + ">>"
# Fields of a tracking record and of a cached detection, likewise.
RECORD_FIELDS = {
    "time": ("DOUBLE", "t_ms"), "camera_target_x": ("DOUBLE", "target_x"), "camera_target_y": ("DOUBLE", "target_y"), "action_spread": ("DOUBLE", "spread"), "player_x": ("DOUBLE", "px"),
    "player_y": ("DOUBLE", "py"), "player_top": ("DOUBLE", "ptop"), "player_bottom": ("DOUBLE", "pbottom"), "player_x1": ("DOUBLE", "px1"), "player_x2": ("DOUBLE", "px2"),
    "player_track_id": ("BIGINT", "track_id"), "ball_x": ("DOUBLE", "ball_x"), "ball_y": ("DOUBLE", "ball_y"), "direct_ball": ("BOOLEAN", "direct"), "ball_guidance": ("BOOLEAN", "guided"),
    "joint_visible": ("BOOLEAN", "joint_visible"), "joint_fit": ("BOOLEAN", "joint_fit"), "joint_span": ("DOUBLE", "joint_span"), "possession": ("BOOLEAN", "possession"),
    "ball_pixel_diameter": ("DOUBLE", "ball_diameter"), "subject_confidence": ("DOUBLE", "subject_confidence"), "scene_cut": ("BOOLEAN", "cut"), "ball_confidence": ("DOUBLE", "ball_confidence"),
    "observed_closeup_box": ("ARRAY<DOUBLE>", "closeup_box"), "allow_outcome_lookahead": ("BOOLEAN", "outcome_lookahead"), "semantic_outcome_region": ("ARRAY<DOUBLE>", "outcome_region"),
    "subject_recently_ball_linked": ("BOOLEAN", "ball_linked"), "pitch_ball": ("BOOLEAN", "pitch_ball"), "origin_track_id": ("BIGINT", "origin_id"), "action_phase": ("STRING", "phase"),
    "camera_owner": ("STRING", "owner"), "payoff_box": ("ARRAY<DOUBLE>", "payoff_box"), "goal_focus_x": ("DOUBLE", "goal_focus_x"),
}
KEYFRAME_FIELDS = {
    "time": ("DOUBLE", "t_ms"), "cameraX": ("DOUBLE", "camera_x"), "cameraY": ("DOUBLE", "camera_y"), "playerCenterX": ("DOUBLE", "player_px"), "playerCenterY": ("DOUBLE", "player_py"),
    "playerTopY": ("DOUBLE", "player_top"), "ballCenterX": ("DOUBLE", "ball_px"), "ballCenterY": ("DOUBLE", "ball_py"), "markerVisible": ("INT", "marker_visible"),
    "ballMarkerVisible": ("INT", "ball_marker_visible"), "ballConfidence": ("DOUBLE", "ball_confidence"), "subjectConfidence": ("DOUBLE", "subject_confidence"), "jointVisible": ("INT", "joint_visible"),
    "jointFit": ("INT", "joint_fit"), "sceneCut": ("INT", "cut"), "cameraCut": ("INT", "camera_cut"), "directBall": ("BOOLEAN", "direct"), "ballGuidance": ("BOOLEAN", "guided"),
    "ballInFrame": ("BOOLEAN", "ball_in_frame"), "playerInFrame": ("BOOLEAN", "player_in_frame"), "playerTrackId": ("BIGINT", "track_id"), "playerEdgeClearance": ("DOUBLE", "player_room"),
    "ballEdgeClearance": ("DOUBLE", "ball_room"), "actionCenterOffset": ("DOUBLE", "offset"), "compositionSafe": ("BOOLEAN", "composition_safe"),
    "outcomeSubjectInFrame": ("BOOLEAN", "outcome_subject_in_frame"), "goalMouthAnchorInFrame": ("BOOLEAN", "goal_anchor_in_frame"), "goalContextInFrame": ("BOOLEAN", "goal_context_in_frame"),
    "cropBox": ("ARRAY<DOUBLE>", "crop"), "payoffRegionInFrame": ("BOOLEAN", "payoff_in_frame"), "actionPhase": ("STRING", "phase"), "originTrackId": ("BIGINT", "origin_id"),
    "highlightMode": ("STRING", "highlight_mode"),
}
DETECTION_FIELDS = {
    "cx": "DOUBLE", "cy": "DOUBLE", "confidence": "DOUBLE", "x1": "DOUBLE", "y1": "DOUBLE", "x2": "DOUBLE", "y2": "DOUBLE", "role": "STRING", "trackId": "BIGINT", "pitchSupport": "DOUBLE",
}


def typed(fields: dict) -> str:
    return "ARRAY<STRUCT<" + ", ".join(f"{k}: {v if isinstance(v, str) else v[0]}" for k, v in fields.items()) + ">>"


TRACKING = f"moments MAP<STRING, STRUCT<sampledFrames: BIGINT, metrics: MAP<STRING, DOUBLE>, keyframes: {typed(KEYFRAME_FIELDS)}, sourceRecords: {typed(RECORD_FIELDS)}>>"
OBSERVATION = f"ARRAY<{typed(DETECTION_FIELDS)}>"


def columns(row: str, fields: dict) -> list[Column]:
    """Each field of the struct ``row`` under its column; seconds become milliseconds."""
    return [(ms(F.col(f"{row}.{k}")) if name.endswith("_ms") else F.col(f"{row}.{k}")).alias(name) for k, (_, name) in fields.items()]


def ms(seconds: Column) -> Column:
    """Seconds on the media clock to whole milliseconds."""
    return F.floor(seconds * 1000 + 0.5).cast("long")


def parse_moments(docs: DataFrame) -> DataFrame:
    """One row per moment of each job document (column ``doc``), job fields denormalised."""
    job = docs.select(F.from_json("doc", JOB).alias("j")).where("j.id IS NOT NULL")
    rows = job.select("j.id", "j.stage", F.posexplode("j.moments").alias("ordinal", "m"))
    return rows.select(F.col("id").alias("job_id"), "stage", "ordinal", *columns("m", MOMENT_FIELDS))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as column ``doc``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return parse_moments(whole_files(spark, path))


def parse_tracking(docs: DataFrame) -> dict[str, DataFrame]:
    """``keyframes``, ``records`` and ``scene_evidence`` of tracking documents.

    Spark's estimate of what it parses out of a document is far too small, and would send the parts of millions of scenes
    through the driver to broadcast them. So the parts are joined by shuffles.
    """
    scene = docs.select(F.explode(F.from_json("doc", TRACKING)["moments"]).alias("moment_id", "s"))
    frames = scene.select("moment_id", F.posexplode("s.keyframes").alias("n", "k"))
    records = scene.select("moment_id", F.posexplode("s.sourceRecords").alias("n", "r"))
    parts = {
        "keyframes": frames.select("moment_id", "n", *columns("k", KEYFRAME_FIELDS)),
        "records": records.select("moment_id", "n", *columns("r", RECORD_FIELDS)),
        "scene_evidence": scene.select("moment_id", F.col("s.sampledFrames").alias("sampled_frames"), F.size("s.keyframes").alias("keyframes"), F.size("s.sourceRecords").alias("records"), F.col("s.metrics").alias("metrics")),
    }
    return {name: part.hint("merge") for name, part in parts.items()}


def read_tracking(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_tracking(whole_files(spark, path))


def parse_observations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and balls of cached payloads ``[people, balls]`` keyed by signature and frame."""
    pair = rows.select("signature", "frame", F.from_json("payload", OBSERVATION).alias("p"))
    side = lambda i: pair.select("signature", "frame", F.posexplode_outer(F.try_element_at("p", F.lit(i))).alias("idx", "d")).select(
        "signature", "frame", "idx", *[F.col(f"d.{c}").alias({"trackId": "track_id", "pitchSupport": "pitch_support"}.get(c, c)) for c in DETECTION_FIELDS])
    return side(1), side(2)


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_observations(spark.read.parquet(path))


def read_shots(shots: DataFrame, sources: DataFrame) -> DataFrame:
    """Cut ledgers that reach at least 90 % of their source."""
    reach = shots.groupBy("match_id").agg(F.max("shot_end_ms").alias("last_ms"))
    ok = sources.join(reach, "match_id").where((F.col("duration_ms") <= 1_000) | (F.col("last_ms") >= F.col("duration_ms") * 0.9)).select("match_id")
    return shots.join(ok, "match_id", "left_semi")


def read_spots(raw: DataFrame) -> DataFrame:
    """Spotter rows: malformed ones dropped, confidence clamped; text columns ``position`` and ``confidence``."""
    t, c = F.col("position").try_cast("long"), F.col("confidence").try_cast("double")
    rows = raw.select(*[x for x in raw.columns if x not in ("position", "confidence", "label")], t.alias("t_ms"), F.coalesce("label", F.lit("Unknown")).alias("label"),
                      F.round(F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))), 6).alias("confidence"))
    return rows.where("t_ms IS NOT NULL AND confidence IS NOT NULL")


# Minimum confidence and kept rows per annotation kind.
ANNOTATION_FLOOR = {"object": 0.25, "person": 0.2, "text": 0.25}
ANNOTATION_CAP = {"object": 80, "person": 40, "text": 240, "speech": 120}


def read_annotations(rows: DataFrame) -> DataFrame:
    """External annotations over their confidence floor, best or earliest first up to each kind's cap.

    The caps are the format's own; they bound the ranking by a constant.
    """
    kind = F.col("kind")
    floor = F.when(kind == "object", 0.25).when(kind == "person", 0.2).when(kind == "text", 0.25).otherwise(0.0)
    cap = F.when(kind == "object", 80).when(kind == "person", 40).when(kind == "text", 240).otherwise(120)
    ok = rows.where((F.col("end_ms") > F.col("start_ms")) & (F.col("confidence") >= floor) & (~kind.isin("text", "speech") | (F.trim(F.coalesce("text", F.lit(""))) != "")))
    order = F.when(kind.isin("object", "person"), -F.col("confidence")).otherwise(F.col("start_ms").cast("double"))
    rank = Window.partitionBy("match_id", "kind").orderBy(order, "ordinal")
    return ok.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= 240).where(F.col("rn") <= cap)


def thin_samples(tracks: DataFrame, n: int = 12) -> DataFrame:
    """Every ⌈len/n⌉-th sample of a track plus its last. A track lives inside one bounded scene."""
    keys = ["match_id", "scene_id", "track_id"]
    w = Window.partitionBy(*keys)
    rows = tracks.withColumns(dict(i=F.row_number().over(w.orderBy("t_ms", "frame")) - 1, len=F.count(F.lit(1)).over(w)))
    step = F.greatest(F.lit(1), F.ceil(F.col("len") / F.lit(n)))
    return rows.where((F.col("i") % step == 0) | (F.col("i") == F.col("len") - 1)).drop("i", "len")


def upsert_observations(new: DataFrame, old: DataFrame) -> DataFrame:
    """Latest payload per signature and frame, by write time; one aggregation, no window."""
    cols = [c for c in old.columns if c not in ("signature", "frame")]
    both = old.unionByName(new)
    return both.groupBy("signature", "frame").agg(F.max_by(F.struct(*cols), F.col("written_us")).alias("_r")).select("signature", "frame", "_r.*")


def upsert_table(new: DataFrame, path: str, parts: int = 64) -> None:
    """Merge ``new`` observations into the table at ``path``, rewriting only the partitions they fall into.

    The table is partitioned by ``part``, a hash of the signature. The merged rows are written to the checkpoint folder
    before they replace anything, so a lost executor costs no old row. A first write creates the table.
    """
    spark = new.sparkSession
    placed = new.withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(parts)).cast("int"))
    merged = placed.drop("part")
    if table_exists(spark, path):
        touched = placed.select("part").distinct()  # at most ``parts`` rows
        old = spark.read.parquet(path).join(F.broadcast(touched), "part", "left_semi").drop("part")
        merged = upsert_observations(merged, old.select(merged.columns))
    else:
        merged = upsert_observations(merged.limit(0), merged)
    out = cut_lineage(merged.withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(parts)).cast("int")))
    out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, in any store that Spark reads, holds anything."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and len(fs.listStatus(at)) > 0


def published(spark: SparkSession, path: str) -> int | None:
    """The version that the pointer at ``path`` names, if any: the highest one whose data were complete."""
    if not table_exists(spark, f"{path}/pointer"):
        return None
    return spark.read.schema("version long").parquet(f"{path}/pointer").agg(F.max("version")).first()[0]


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a version's data, then the pointer row that publishes it.

    Readers follow the pointer, so a run that stops in between leaves the former version visible, and the next attempt
    overwrites what it left. A published version, or one older than that, is not written again.
    """
    spark, target = df.sparkSession, f"{path}/data/version={version}"
    now = published(spark, path)
    if now is None or version > now:
        df.write.mode("overwrite").parquet(target)
        spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return target


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the published version under ``path``."""
    version = published(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/data/version={version}")


def snapshot_batches(path: str):
    """A ``foreachBatch`` function that publishes each micro-batch once, however often it is tried."""
    return lambda df, batch_id: write_snapshot(df, path, batch_id + 1)


def dedup_uploads(files: DataFrame) -> DataFrame:
    """One row per distinct content, keeping the first path. ``content`` is binary, as ``binaryFile`` reads it."""
    hashed = files.select("path", F.sha2("content", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return dedup_uploads(spark.read.format("binaryFile").load(path))


def nearest_observation(obs: DataFrame, wanted: DataFrame, reach: int = 2) -> DataFrame:
    """Closest cached frame within two of each wanted one; the larger payload wins a tie."""
    near = wanted.select("signature", "want", F.explode(F.sequence(F.col("want") - reach, F.col("want") + reach)).alias("frame"))
    hit = near.join(obs.select("signature", "frame", F.length("payload").alias("size")), ["signature", "frame"])
    return hit.groupBy("signature", "want").agg(F.min(F.struct(F.abs(F.col("frame") - F.col("want")).alias("d"), (-F.col("size")).alias("s"), "frame")).alias("b")).select("signature", "want", F.col("b.frame").alias("frame"))


def usable_results(results: DataFrame) -> DataFrame:
    """Cached results with sampled frames and records."""
    return results.where((F.coalesce("sampled_frames", F.lit(0)) > 0) & (F.coalesce("records", F.lit(0)) > 0))
