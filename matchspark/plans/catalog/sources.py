"""Queries over parsed documents, caches, annotations and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchspark.operators import moments as M
from matchspark.plans.registry import query
from matchspark.session import ensure_checkpoint_dir
from matchspark.sources import readers as R

DOC = """concat('{"id":"job-', CAST(match_id AS STRING), '","stage":"ranking","moments":[{"id":"', moment_id, '","startTime":', CAST(start_ms / 1000e0 AS STRING), ',"endTime":', CAST(end_ms / 1000e0 AS STRING), ',"eventType":"', event_type, '","confidence":0.5,"isReplay":',
  CASE WHEN is_replay THEN 'true' ELSE 'false' END, '},{"id":"', moment_id, '-b","startTime":1.0,"endTime":2.5,"eventType":"save","ballVisible":true}]}')"""


@query("read_moments", """SELECT 'job-' || match_id AS job_id, 0 AS ordinal, moment_id, start_ms, end_ms, event_type, is_replay, CAST(NULL AS BOOLEAN) AS ball_visible FROM moments_v UNION ALL SELECT 'job-' || match_id, 1, moment_id || '-b', 1000, 2500, 'save', NULL, true FROM moments_v""")
def _(v):
    return R.parse_moments(v.moments.selectExpr(f"{DOC} AS doc")).select("job_id", "ordinal", "moment_id", "start_ms", "end_ms", "event_type", "is_replay", "ball_visible")


TRK = """concat('{"moments":{"', moment_id, '":{"sampledFrames":3,"keyframes":[{"time":0.1,"cameraX":0.5,"directBall":true},{"time":', CAST(ordinal % 9 AS STRING), '.25,"cameraX":0.25,"directBall":false}],"sourceRecords":[{"time":0.2,"ball_x":0.75,"direct_ball":true}]}}}')"""


@query("read_tracking", "SELECT moment_id, 0 AS n, 100 AS t_ms, 0.5e0 AS camera_x, true AS direct FROM moments_v UNION ALL SELECT moment_id, 1, ordinal % 9 * 1000 + 250, 0.25e0, false FROM moments_v")
def _(v):
    return R.parse_tracking(v.moments.selectExpr(f"{TRK} AS doc"))["keyframes"].select("moment_id", "n", "t_ms", "camera_x", "direct")


OBS = ["concat('sig', CAST(match_id AS STRING)) AS signature", "ordinal AS frame", """CASE WHEN ordinal % 5 = 0 THEN '[[],[]]' ELSE concat('[[{"cx":0.5,"cy":0.25,"confidence":0.', CAST(ordinal % 9 + 1 AS STRING), '}],[{"cx":0.1,"cy":0.2,"confidence":0.3},{"cx":0.4,"cy":0.5,"confidence":0.6}]]') END AS payload""", "ordinal * 10 AS written_us"]


@query("read_observations", "SELECT 'sig' || match_id AS signature, ordinal AS frame, i AS idx, CASE i WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.4e0 END AS cx, CASE i WHEN 0 THEN 0.3e0 WHEN 1 THEN 0.6e0 END AS confidence FROM moments_v, (SELECT unnest([0, 1]) AS i) WHERE ordinal % 5 <> 0 UNION ALL SELECT 'sig' || match_id, ordinal, NULL, NULL, NULL FROM moments_v WHERE ordinal % 5 = 0")
def _(v):
    return R.parse_observations(v.moments.selectExpr(*OBS))[1].select("signature", "frame", "idx", "cx", "confidence")


RECORD = """concat('{"moments":{"', moment_id, '":{"sampledFrames":3,"metrics":{"jointCoverage":0.', CAST(ordinal % 10 AS STRING), '},"keyframes":[{"time":1.5,"cropBox":[0.1,0.2,0.3,0.4],"jointFit":1,"payoffRegionInFrame":true}],"sourceRecords":[{"time":0.2,"ball_x":0.75,"player_x1":0.25,"player_track_id":', CAST(ordinal % 7 AS STRING), ',"scene_cut":false,"possession":', CASE WHEN ordinal % 2 = 0 THEN 'true' ELSE 'null' END, ',"action_phase":"flight","payoff_box":[0.5,0.5,0.75,0.75]}]}}}')"""


@query("read_records", "SELECT moment_id, 0 AS n, 200 AS t_ms, 0.75e0 AS ball_x, 0.25e0 AS px1, ordinal % 7 AS track_id, false AS cut, CASE WHEN ordinal % 2 = 0 THEN true END AS possession, 'flight' AS phase, 0.75e0 AS payoff_x2, (ordinal % 10) / 10e0 AS joint_coverage, 0.4e0 AS crop_y2 FROM moments_v")
def _(v):
    parts = R.parse_tracking(v.moments.selectExpr(f"{RECORD} AS doc"))
    rows = parts["records"].join(parts["scene_evidence"], "moment_id").join(parts["keyframes"].select("moment_id", "crop"), "moment_id")
    return rows.selectExpr("moment_id", "n", "t_ms", "ball_x", "px1", "track_id", "cut", "possession", "phase", "payoff_box[2] AS payoff_x2", "metrics['jointCoverage'] AS joint_coverage", "crop[3] AS crop_y2")


@query("read_shots", "SELECT match_id, shot_id FROM shots_v WHERE match_id IN (SELECT match_id FROM shots_v GROUP BY match_id HAVING max(shot_end_ms) >= (5900000 + match_id * 1000) * 0.9e0)")
def _(v):
    return R.read_shots(v.shots, v.sources.selectExpr("match_id", "5900000 + match_id * 1000 AS duration_ms")).select("match_id", "shot_id")


SPT = ["match_id", "ordinal", "CASE WHEN ordinal % 7 = 0 THEN 'soon' ELSE CAST(start_ms AS STRING) END AS position", "CASE WHEN ordinal % 11 = 0 THEN 'n/a' ELSE CAST(confidence * 2 - 1 AS STRING) END AS confidence", "CASE WHEN ordinal % 3 <> 0 THEN event_type END AS label"]


@query("read_spots", "SELECT match_id, ordinal, start_ms AS t_ms, coalesce(CASE WHEN ordinal % 3 <> 0 THEN event_type END, 'Unknown') AS label, round(least(1e0, greatest(0e0, confidence * 2 - 1)), 6) AS confidence FROM moments_v WHERE ordinal % 7 <> 0 AND ordinal % 11 <> 0")
def _(v):
    return R.read_spots(v.moments.selectExpr(*SPT))


ANN = ["match_id", "ordinal", "CASE ordinal % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'person' WHEN 2 THEN 'text' ELSE 'speech' END AS kind", "(ordinal * 7 % 100) / 128e0 AS confidence", "start_ms", "CASE WHEN ordinal % 13 = 0 THEN start_ms ELSE end_ms END AS end_ms", "CASE WHEN ordinal % 9 = 0 THEN ' ' ELSE description END AS text"]


@query("read_annotations", f"""WITH a AS (SELECT {', '.join(ANN)} FROM moments_v), k AS (SELECT * FROM a WHERE end_ms > start_ms AND confidence >= CASE kind WHEN 'object' THEN 0.25e0 WHEN 'person' THEN 0.2e0 WHEN 'text' THEN 0.25e0 ELSE 0 END AND (kind IN ('object', 'person') OR trim(text) <> ''))
  SELECT match_id, ordinal, kind FROM k QUALIFY row_number() OVER (PARTITION BY match_id, kind ORDER BY CASE WHEN kind IN ('object', 'person') THEN -confidence ELSE start_ms END, ordinal) <= CASE kind WHEN 'object' THEN 80 WHEN 'person' THEN 40 WHEN 'text' THEN 240 ELSE 120 END""")
def _(v):
    return R.read_annotations(v.moments.selectExpr(*ANN)).select("match_id", "ordinal", "kind")


@query("thin_samples", """WITH t AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY match_id, scene_id, track_id) AS n FROM players_v WINDOW w AS (PARTITION BY match_id, scene_id, track_id ORDER BY t_ms, frame, idx))
  SELECT match_id, scene_id, track_id, frame, idx FROM t WHERE i % greatest(1, CAST(ceil(n / 12) AS BIGINT)) = 0 OR i = n - 1""")
def _(v):
    p = v.players.withColumn("frame2", F.col("frame")).withColumn("frame", F.col("frame") * 8 + F.col("idx"))
    return R.thin_samples(p, 12).select("match_id", "scene_id", "track_id", F.col("frame2").alias("frame"), "idx")


@query("upsert_observations", """WITH b AS (SELECT 'sig' || match_id AS signature, ordinal // 3 AS frame, ordinal, ordinal * 10 AS written_us FROM moments_v) SELECT signature, frame, arg_max('p' || ordinal, written_us) AS payload, max(written_us) AS written_us FROM b GROUP BY ALL""")
def _(v):
    rows = v.moments.selectExpr("concat('sig', CAST(match_id AS STRING)) AS signature", "ordinal div 3 AS frame", "concat('p', CAST(ordinal AS STRING)) AS payload", "ordinal * 10 AS written_us", "ordinal")
    return R.upsert_observations(rows.where("ordinal % 2 = 0").drop("ordinal"), rows.where("ordinal % 2 = 1").drop("ordinal"))


@query("upsert_table", """WITH b AS (SELECT 'sig' || match_id AS signature, ordinal // 3 AS frame, ordinal, ordinal * 10 AS written_us FROM moments_v) SELECT signature, frame, arg_max('p' || ordinal, written_us) AS payload, max(written_us) AS written_us FROM b GROUP BY ALL""")
def _(v):
    rows = v.moments.selectExpr("concat('sig', CAST(match_id AS STRING)) AS signature", "ordinal div 3 AS frame", "concat('p', CAST(ordinal AS STRING)) AS payload", "ordinal * 10 AS written_us", "ordinal")
    path = f"{ensure_checkpoint_dir(v.spark)}/observations/{uuid.uuid4().hex}"
    for turn in (1, 0, 2):
        R.upsert_table(rows.where(f"ordinal % 3 = {turn}").drop("ordinal"), path, 16)
    return v.spark.read.parquet(path).drop("part")


@query("dedup_uploads", "SELECT sha256(text) AS digest, 'f' || min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, count(*) AS copies FROM documents GROUP BY text")
def _(v):
    files = v.parquet("documents").select(F.expr("concat('f', lpad(CAST(doc_id AS STRING), 9, '0'))").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return R.dedup_uploads(files)


@query("nearest_observation", """WITH o AS (SELECT 'sig' || match_id AS signature, start_ms // 40 AS frame, max(ordinal % 7 + 1) AS size FROM moments_v WHERE ordinal % 2 = 0 GROUP BY ALL), w AS (SELECT DISTINCT 'sig' || match_id AS signature, (start_ms + 60) // 40 AS want FROM moments_v)
  SELECT w.signature, want, arg_min(frame, struct_pack(d := abs(frame - want), s := -size, f := frame)) AS frame FROM w JOIN o ON o.signature = w.signature AND abs(frame - want) <= 2 GROUP BY ALL""")
def _(v):
    obs = v.moments.where("ordinal % 2 = 0").selectExpr("concat('sig', CAST(match_id AS STRING)) AS signature", "start_ms div 40 AS frame", "repeat('x', CAST(ordinal % 7 + 1 AS INT)) AS payload")
    return R.nearest_observation(obs, v.moments.selectExpr("concat('sig', CAST(match_id AS STRING)) AS signature", "(start_ms + 60) div 40 AS want").distinct())


@query("usable_results", "SELECT moment_id FROM moments_v WHERE ordinal % 4 <> 0 AND ordinal % 6 > 0")
def _(v):
    return R.usable_results(v.moments.selectExpr("moment_id", "CASE WHEN ordinal % 4 <> 0 THEN 5 END AS sampled_frames", "ordinal % 6 AS records")).select("moment_id")


MK = ["match_id", "mask_id", "mask_confidence AS width"]


@query("default_masks", """WITH d AS (SELECT match_id, mask_id FROM masks_v WHERE mask_confidence > 0.5e0), u AS (SELECT match_id, 'broadcast-' || n AS mask_id FROM sources_v, (SELECT unnest(['scorebug', 'header', 'channel-bug']) AS n) WHERE match_id % 3 = 0)
  SELECT * FROM d UNION ALL SELECT * FROM u UNION ALL SELECT match_id, 'fallback-top-right-watermark' FROM sources_v WHERE match_id % 3 <> 0 AND match_id NOT IN (SELECT match_id FROM d)""")
def _(v):
    found = v.masks.where("mask_confidence > 0.5").select("match_id", "mask_id", F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    return M.default_masks(v.sources.selectExpr("match_id", "match_id % 3 = 0 AS ui_masks"), found).select("match_id", "mask_id")


BX = ["match_id", "moment_id", "CASE WHEN ordinal % 9 = 0 THEN NULL WHEN ordinal % 9 = 1 THEN array(1e0, 2e0) ELSE array(CAST(ordinal % 900 AS DOUBLE), CAST(ordinal % 700 AS DOUBLE), CAST(ordinal % 900 + ordinal % 130 AS DOUBLE), CAST(ordinal % 700 + 90 AS DOUBLE)) END AS box"]


@query("decode_boxes", """WITH b AS (SELECT moment_id, ordinal % 9 > 1 AND ordinal % 130 > 0 AND ordinal % 900 + ordinal % 130 <= 1000 AS ok, ordinal FROM moments_v) SELECT moment_id, CASE WHEN ok THEN (ordinal % 700) / 1000e0 END AS x1, CASE WHEN ok THEN (ordinal % 900) / 1000e0 END AS y1, CASE WHEN ok THEN (ordinal % 700 + 90) / 1000e0 END AS x2,
   CASE WHEN ok THEN (ordinal % 900 + ordinal % 130) / 1000e0 END AS y2, CASE WHEN ordinal % 9 > 0 AND NOT ok THEN 'invalid_box' END AS issue FROM b""")
def _(v):
    return M.decode_boxes(v.moments.selectExpr(*BX)).select("moment_id", "x1", "y1", "x2", "y2", "issue")
