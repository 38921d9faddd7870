"""Queries over reviewed clip clocks, locks, cues and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchspark.operators import tracks as T
from matchspark.operators import windows as W
from matchspark.plans.registry import query
from matchspark.session import ensure_checkpoint_dir
from matchspark.sources import readers as R

REACT = "(event_type = 'celebration' OR story_phase = 'reaction')"
REEL = "CASE WHEN ordinal % 3 = 0 THEN 40000 ELSE 0 END"
L = "(end_ms - start_ms)"
RC = ["match_id", "moment_id", "ordinal", "event_type", "ordinal % 9 <> 2 AS r_verified", "ordinal % 7 <> 3 AS r_complete", f"CASE WHEN ordinal % 6 = 5 THEN 0 ELSE 40000 END AS reel_start_ms", f"CASE WHEN ordinal % 6 = 5 THEN 0 ELSE 40000 END + {L} AS reel_end_ms",
      f"origin_ms - start_ms + {REEL} AS origin_ms", f"contact_ms - start_ms + {REEL} AS contact_ms", f"flight_ms - start_ms + {REEL} AS flight_ms", f"handoff_ms - start_ms + {REEL} AS handoff_ms", f"payoff_start_ms - start_ms + {REEL} AS payoff_start_ms",
      f"CASE WHEN ordinal % 4 = 0 THEN {L} - 20 + ordinal % 150 ELSE payoff_end_ms - start_ms END + {REEL} AS payoff_end_ms", f"0 + {REEL} AS w_start_ms", f"{L} - 40 + {REEL} AS w_end_ms", "ordinal % 8 <> 6 AS window_proven", "proof_verified", "proof_event", f"payoff_start_ms - start_ms + 10 + {REEL} AS proof_start_ms",
      f"{L} - 60 - ordinal % 100 + {REEL} AS proof_end_ms", "0.1e0 AS box_x1", "0.1e0 AS box_y1", "0.4e0 AS box_x2", "0.5e0 AS box_y2"]
CLK = W.CLIP_CLOCKS
RC_SQL = f"""rc AS (SELECT {', '.join(RC)} FROM moments_v), rm AS (SELECT *, reel_start_ms > 0 AND len([x FOR x IN [{', '.join(CLK)}] IF x < reel_start_ms - 20 OR x > reel_end_ms + 50]) = 0 AND (len([x FOR x IN [{', '.join(CLK)}] IF x > reel_end_ms - reel_start_ms + 50]) >= 2
    OR (abs(origin_ms - reel_start_ms) <= 20 AND len([x FOR x IN [{', '.join(CLK)}] IF x > reel_end_ms - reel_start_ms + 50]) >= 1)) AS clock_moved FROM rc),
 rs AS (SELECT * REPLACE ({', '.join(f'CASE WHEN clock_moved THEN {c} - reel_start_ms ELSE {c} END AS {c}' for c in [*CLK, 'proof_start_ms', 'proof_end_ms', 'w_start_ms', 'w_end_ms'])}) FROM rm),
 rh AS (SELECT *, coalesce(r_verified AND r_complete AND window_proven AND proof_verified AND proof_event = event_type AND payoff_end_ms - w_end_ms BETWEEN 1 AND 126 AND contact_ms >= w_start_ms AND payoff_start_ms >= contact_ms AND proof_start_ms >= payoff_start_ms AND proof_end_ms > proof_start_ms AND w_end_ms - proof_end_ms BETWEEN 0 AND 126, false) AS held FROM rs),
 rf AS (SELECT * REPLACE (CASE WHEN held THEN proof_end_ms ELSE payoff_end_ms END AS payoff_end_ms) FROM rh)"""


def clips(v):
    return v.moments.selectExpr(*RC)


@query("fix_reel_clock", f"WITH {RC_SQL} SELECT moment_id, clock_moved, {', '.join(CLK)} FROM rs")
def _(v):
    return W.fix_reel_clock(clips(v)).select("moment_id", "clock_moved", *CLK)


@query("fix_result_hold", f"WITH {RC_SQL} SELECT moment_id, held, payoff_end_ms FROM rf")
def _(v):
    return W.fix_result_hold(W.fix_reel_clock(clips(v))).select("moment_id", "held", "payoff_end_ms")


@query("invalid_timing", f"""WITH {RC_SQL}, n AS (SELECT *, reel_end_ms - reel_start_ms AS n FROM rf WHERE r_verified AND r_complete AND event_type IN ({', '.join(repr(e) for e in W.PLAY_EVENTS)}))
  SELECT match_id, moment_id FROM n WHERE origin_ms IS NULL OR contact_ms IS NULL OR payoff_start_ms IS NULL OR payoff_end_ms IS NULL OR len([x FOR x IN [{', '.join(CLK)}] IF x < -50 OR x > n + 50]) > 0 OR contact_ms < origin_ms - 50 OR payoff_start_ms < contact_ms - 125 OR payoff_end_ms <= payoff_start_ms
   OR payoff_end_ms <= contact_ms + 50 OR w_start_ms < 0 OR w_end_ms > n + 1 OR w_end_ms <= w_start_ms OR contact_ms < w_start_ms - 1 OR payoff_start_ms >= w_end_ms OR payoff_end_ms > w_end_ms + 1""")
def _(v):
    return W.invalid_timing(clips(v))


RVF = ["moment_id", "event_type", "story_phase", "ordinal % 11 <> 1 AS passed", "ordinal % 13 <> 2 AS correct_subject", "true AS stable_camera", "ordinal % 3 = 0 AS subject_core", "ordinal % 19 <> 4 AS ball_followed", "ordinal % 23 <> 5 AS setup_visible", "CASE WHEN ordinal % 29 <> 6 THEN true END AS contact_visible",
       "true AS outcome_visible", "ordinal % 4 = 0 AS setup_seen", "true AS contact_seen", "true AS payoff_seen", "ordinal % 3 AS observation_count"]


@query("review_failures", f"""WITH r AS (SELECT {', '.join(RVF)}, ordinal, {REACT} AS s FROM moments_v) SELECT moment_id, array_to_string(list_sort([x FOR x IN [CASE WHEN NOT passed THEN 'passed' END, CASE WHEN NOT correct_subject THEN 'correct_subject' END, CASE WHEN s AND NOT subject_core THEN 'subject_core' END, CASE WHEN NOT s AND NOT ball_followed THEN 'ball_followed' END,
   CASE WHEN NOT s AND NOT setup_visible THEN 'setup_visible' END, CASE WHEN NOT s AND contact_visible IS NULL THEN 'contact_visible' END, CASE WHEN observation_count < 2 AND NOT (NOT s AND setup_seen) THEN 'timestamped_crop_evidence' END, CASE WHEN ordinal % 5 = 0 THEN 'receiverVisible' END] IF x IS NOT NULL]), ',') AS missing FROM r""")
def _(v):
    rows = v.moments.selectExpr(*RVF, "array('receiverVisible', 'reboundFollowed') AS required", "CASE WHEN ordinal % 5 = 0 THEN array('reboundFollowed') ELSE array('receiverVisible', 'reboundFollowed') END AS granted")
    return W.review_failures(rows).select("moment_id", "missing")


@query("sample_windows", """WITH n AS (SELECT match_id, moment_id, end_ms - start_ms AS len, CAST(ceil((end_ms - start_ms) * 8 / 1000 - 1e-9) AS BIGINT) AS n FROM moments_v), b AS (SELECT *, i AS batch, least(80, n - i * 80) AS ticks FROM n, (SELECT unnest(range(10)) AS i) WHERE i * 80 < n)
  SELECT match_id, moment_id, batch, ticks, greatest(0, CAST(floor((batch * 80 - 2) * 1000 / 8) AS BIGINT)) AS from_ms, least(len, CAST(floor((batch * 80 + ticks + 2) * 1000 / 8) AS BIGINT)) AS to_ms FROM b""")
def _(v):
    return W.sample_windows(v.moments.selectExpr("match_id", "moment_id", "end_ms - start_ms AS length_ms"), 8)


@query("write_snapshot", "SELECT moment_id, event_type FROM moments_v WHERE ordinal % 2 = 1")
def _(v):
    path = f"{ensure_checkpoint_dir(v.spark)}/snapshots/{uuid.uuid4().hex}"
    for version in (1, 2):
        R.write_snapshot(v.moments.where(f"ordinal % 2 = {version - 1}").select("moment_id", "event_type"), path, version)
    return R.latest_snapshot(v.spark, path)


AC = ["match_id", "scene_id", "CAST(500 AS BIGINT) AS from_ms", "CAST(2200 AS BIGINT) AS to_ms", "match_id % 4 AS subject"]


@query("annotation_cue", f"""WITH s AS (SELECT {', '.join(AC)} FROM (SELECT DISTINCT match_id, scene_id FROM frames_v)), r AS (SELECT f.*, to_ms, coalesce(ball_x IS NOT NULL AND joint_fit AND track_id = subject, false) AS ok FROM frames_v f JOIN s USING (match_id, scene_id) WHERE t_ms BETWEEN 500 AND 2200),
  g AS (SELECT match_id, scene_id, count(*) AS n, count(*) FILTER (ok) AS k, median(subject_confidence) FILTER (ok) AS m, min(struct_pack(t := t_ms, b := ball_confidence)) FILTER (ok) AS f FROM r GROUP BY ALL), c AS (SELECT *, least(1e0, m * 0.68e0 + k / n * 0.24e0 + least(1e0, f.b / 0.45e0) * 0.08e0) AS c FROM g WHERE k > 0)
  SELECT match_id, scene_id, f.t AS cue_ms, round(c + 1e-9, 5) AS confidence, CASE WHEN c >= 0.58e0 THEN 'arrow' ELSE 'none' END AS style, least(2400, greatest(600, 2200 - f.t)) AS hold_ms FROM c""")
def _(v):
    return T.annotation_cue(v.frames, v.frames.select("match_id", "scene_id").distinct().selectExpr(*AC))


@query("possession_lock")
def _(v):
    return T.possession_lock(v.players, v.frames.select("match_id", "scene_id", "frame", "t_ms", "cut", "ball_x", "ball_y"), 0.5)


KD = ["match_id", "scene_id", "frame", "idx", "0.2e0 AS ends_distance", "((ordinal * 7 + idx) % 50) / 128e0 AS to_from", "((ordinal * 11 + idx) % 50) / 128e0 AS to_to"]
PS = ["match_id", "scene_id", "frame", "k % 9 AS from_id", "(k + 1) % 9 AS to_id"]


@query("support_players", f"""WITH k AS (SELECT {', '.join(KD)} FROM players_v), s AS (SELECT {', '.join(PS)} FROM frames_v), j AS (SELECT p.*, to_from, to_to, least(sqrt(pow(p.cx - a.cx, 2) + pow(p.y2 - a.y2, 2)), sqrt(pow(p.cx - b.cx, 2) + pow(p.y2 - b.y2, 2))) AS sp FROM players_v p JOIN s USING (match_id, scene_id, frame)
    JOIN players_v a ON a.match_id = p.match_id AND a.scene_id = p.scene_id AND a.frame = p.frame AND a.track_id = from_id JOIN players_v b ON b.match_id = p.match_id AND b.scene_id = p.scene_id AND b.frame = p.frame AND b.track_id = to_id
    JOIN k ON k.match_id = p.match_id AND k.scene_id = p.scene_id AND k.frame = p.frame AND k.idx = p.idx WHERE p.track_id <> from_id AND p.track_id <> to_id)
  SELECT match_id, scene_id, frame, idx FROM j WHERE confidence >= 0.48e0 AND pitch_support >= 0.08e0 AND track_age >= 2 AND greatest(to_from, to_to) <= 0.3e0 AND sp BETWEEN 0.045e0 AND 0.45e0 QUALIFY row_number() OVER (PARTITION BY match_id, scene_id, frame ORDER BY (to_from + to_to) / 2 - confidence * 0.05e0, idx) <= 2""")
def _(v):
    return T.support_players(v.players, v.frames.selectExpr(*PS), v.players.selectExpr(*KD))
