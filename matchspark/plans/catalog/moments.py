"""Queries over candidate moments: projections, predicates and the flagship plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators import moments as M
from matchspark.operators import selection as SEL
from matchspark.plans.registry import query

WEIGHT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EVENT_WEIGHTS.items()) + " END"
SCORED_SQL = f"""scored AS (
  SELECT *, least(100, greatest(0, floor({WEIGHT_SQL} + CASE WHEN ball_visible THEN 5 ELSE -14 END
    + CASE WHEN player_visible THEN 4 ELSE -10 END + (confidence - 0.5e0) * 14
    - CASE WHEN duplicate_group IS NOT NULL THEN 8 ELSE 0 END + 0.5e0))) AS score FROM moments_v)"""
PACK_SQL = f"""WITH RECURSIVE {SCORED_SQL},
 firsts AS (SELECT * FROM scored QUALIFY duplicate_group IS NULL OR row_number() OVER (PARTITION BY match_id, duplicate_group ORDER BY ordinal) = 1),
 ranked AS (SELECT match_id, moment_id, end_ms - start_ms AS len,
     row_number() OVER (PARTITION BY match_id ORDER BY score DESC, start_ms, ordinal) AS rn
   FROM firsts WHERE end_ms > start_ms AND confidence >= 0.5e0),
 walk(match_id, rn, used, full_up, moment_id, hit) AS (
   SELECT match_id, 0::BIGINT, 0::BIGINT, false, NULL::VARCHAR, false FROM (SELECT DISTINCT match_id FROM ranked)
   UNION ALL
   SELECT r.match_id, r.rn,
     CASE WHEN NOT w.full_up AND w.used + r.len <= 60250 THEN w.used + r.len ELSE w.used END,
     w.full_up OR (w.used + r.len <= 60250 AND w.used + r.len >= 57000),
     r.moment_id, NOT w.full_up AND w.used + r.len <= 60250
   FROM walk w JOIN ranked r ON r.match_id = w.match_id AND r.rn = w.rn + 1),
 packed AS (SELECT s.*, EXISTS (SELECT 1 FROM walk w WHERE w.hit AND w.match_id = s.match_id AND w.moment_id = s.moment_id) AS chosen FROM scored s)"""


def scored(v):
    return M.score_moments(v.moments)


@query("score_moments", f"WITH {SCORED_SQL} SELECT match_id, moment_id, CAST(score AS BIGINT) AS score FROM scored")
def _(v):
    return scored(v).select("match_id", "moment_id", F.col("importance").cast("long").alias("score"))


@query("first_per_group", """SELECT match_id, moment_id, duplicate_group FROM moments_v
  QUALIFY duplicate_group IS NULL OR row_number() OVER (PARTITION BY match_id, duplicate_group ORDER BY ordinal) = 1""")
def _(v):
    return SEL.first_per_group(v.moments.select("match_id", "moment_id", "ordinal", "duplicate_group")).drop("ordinal")


@query("pack_timeline", PACK_SQL + " SELECT match_id, moment_id, chosen AS selected FROM packed")
def _(v):
    return SEL.pack_timeline(scored(v), 60_000).select("match_id", "moment_id", "selected")


@query("edit_plan", PACK_SQL + """, hits AS (SELECT p.match_id, p.moment_id, count(*) AS n FROM packed p JOIN masks_v k
     ON k.match_id = p.match_id AND k.mask_confidence >= 0.72e0 AND k.first_ms < p.end_ms AND k.last_ms > p.start_ms
     WHERE p.chosen GROUP BY ALL)
  SELECT p.match_id, row_number() OVER (PARTITION BY p.match_id ORDER BY start_ms, ordinal) AS segment, p.moment_id, event_type, start_ms, end_ms,
    coalesce(goal_focus_x, 0.5e0) AS focus_x, 0.28e0 AS audio_gain, coalesce(n, 0) AS mask_count,
    concat('dynamic_crop', CASE WHEN player_visible THEN ',highlight' ELSE '' END, CASE WHEN commentary IS NOT NULL THEN ',caption' ELSE '' END,
      CASE WHEN n > 0 THEN ',overlay_blur' ELSE '' END, CASE WHEN event_type IN ('goal', 'save', 'big_chance') THEN ',zoom' ELSE '' END) AS effects
  FROM packed p LEFT JOIN hits USING (match_id, moment_id) WHERE chosen""")
def _(v):
    picked = SEL.pack_timeline(scored(v), 60_000).withColumn("focus_x", F.col("goal_focus_x"))
    return M.edit_plan(picked, v.masks)


@query("normalize_score_scale", """SELECT moment_id, CAST(floor(CASE WHEN s > 0 AND s <= 10 THEN least(100, s * 10) ELSE least(100, greatest(0, s)) END + 0.5e0) AS BIGINT) AS score
  FROM (SELECT moment_id, CASE WHEN ordinal % 7 = 0 THEN 45e0 WHEN ordinal % 7 = 1 THEN 0e0 ELSE (ordinal % 1300 - 100) / 8e0 END AS s FROM moments_v)""")
def _(v):
    text = F.when(F.expr("ordinal % 7 = 0"), F.lit("n/a")).when(F.expr("ordinal % 7 = 1"), F.lit(" ")).otherwise(
        F.expr("CAST((ordinal % 1300 - 100) / 8e0 AS STRING)"))
    return v.moments.select("moment_id", S.normalize_score_scale(text, 45).alias("score"))


@query("match_clock_seconds", r"""SELECT match_id, sample_id, CASE WHEN regexp_matches(clock, '^(\d{1,3}):(\d{2})(?:\s*\+\s*(\d{1,2})(?::(\d{2}))?)?$')
   THEN CASE WHEN clock LIKE '%+%' THEN 45*60 + 2*60 + 30 ELSE CAST(split_part(clock, ':', 1) AS BIGINT) * 60 + CAST(split_part(clock, ':', 2) AS BIGINT) END END AS seconds
  FROM score_samples_v""")
def _(v):
    return v.score_samples.select("match_id", "sample_id", S.match_clock_seconds(F.col("clock")).alias("seconds"))


OBSERVED = ["*", "CASE WHEN ordinal % 10 = 9 THEN 0 ELSE 2 END AS shot_count", "CASE WHEN ordinal % 6 = 5 THEN 'save' ELSE event_type END AS outcome",
            "CASE WHEN ordinal % 8 = 7 THEN '  ' ELSE description END AS setup_text", "CASE WHEN ordinal % 13 = 4 THEN NULL ELSE 'runs on' END AS continuation_text", "CASE WHEN ordinal % 17 = 6 THEN '' ELSE 'ends' END AS result_text", "ordinal % 5 <> 4 AS initiator_seen",
            "ordinal % 7 <> 6 AS continuation_seen", "ordinal % 9 <> 8 AS result_seen"]


@query("observation_problems", f"""WITH o AS (SELECT {', '.join(OBSERVED)}, (event_type = 'celebration' OR story_phase = 'reaction') AS react FROM moments_v)
  SELECT moment_id, array_to_string(list_sort([x FOR x IN [
    CASE WHEN start_ms < 0 OR end_ms > 5400050 OR end_ms - start_ms < 500 THEN 'invalid_excerpt_clock' END,
    CASE WHEN shot_count < 1 THEN 'missing_camera_shots' END,
    CASE WHEN trim(coalesce(story_id, '')) = '' THEN 'missing_incident_id' END,
    CASE WHEN confidence < 0 OR confidence > 1 THEN 'invalid_confidence' END,
    CASE WHEN action_complete IS NOT TRUE OR keep_decision = 'reject' THEN 'incomplete_action' END,
    CASE WHEN trim(setup_text) = '' OR continuation_text IS NULL OR result_text = '' OR coalesce(outcome, '') = '' THEN 'missing_source_description' END,
    CASE WHEN outcome <> event_type THEN 'outcome_class_conflict' END,
    CASE WHEN NOT react AND NOT (ball_visible IS TRUE AND player_visible IS TRUE AND initiator_seen AND continuation_seen AND result_seen) THEN 'missing_visible_action_phase' END,
    CASE WHEN NOT react AND (origin_ms IS NULL OR contact_ms IS NULL OR flight_ms IS NULL
       OR NOT (origin_ms BETWEEN start_ms AND end_ms AND contact_ms BETWEEN start_ms AND end_ms AND flight_ms BETWEEN start_ms AND end_ms
         AND payoff_start_ms BETWEEN start_ms AND end_ms AND payoff_end_ms BETWEEN start_ms AND end_ms)
       OR origin_ms > contact_ms OR origin_ms > flight_ms OR origin_ms > payoff_start_ms OR contact_ms > payoff_end_ms
       OR flight_ms > payoff_end_ms OR payoff_start_ms > payoff_end_ms) THEN 'invalid_action_phase_clock' END,
    CASE WHEN react AND NOT result_seen THEN 'unobserved_reaction' END] IF x IS NOT NULL]), ',') AS problems FROM o""")
def _(v):
    return M.observation_problems(v.moments.selectExpr(*OBSERVED), 5_400_000).select("moment_id", "problems")


EXTRA = ["save", "shot_on_target", "shot_off_target", "big_chance", "tackle", "free_kick", "normal_play", "assist", "dribble"]


@query("quarantine_drafts", f"""SELECT moment_id, CASE WHEN clock_bad THEN 'invalid_excerpt_local_clock,' ELSE '' END || 'invalid_scene_metadata' AS reasons
  FROM (SELECT *, end_ms > 5400050 AS clock_bad FROM moments_v)
  WHERE clock_bad OR confidence > 1 OR story_phase NOT IN ('action', 'reaction', 'replay')
    OR event_type NOT IN ({', '.join(repr(e) for e in EXTRA)}) OR action_complete IS NULL""")
def _(v):
    _, bad = M.quarantine_drafts(v.moments, 5_400_000, EXTRA)
    return bad.select("moment_id", "reasons")


NOTED = ["CASE WHEN ordinal % 3 <> 0 THEN start_ms - 300 + 150 * (ordinal % 11) END AS annotation_start_ms", "CASE WHEN ordinal % 4 <> 0 THEN end_ms - 700 * (ordinal % 13) END AS annotation_end_ms"]


@query("normalize_brief", f"""WITH p AS (SELECT *, {', '.join(NOTED)}, greatest(1, end_ms - start_ms) AS len, (event_type = 'celebration' OR story_phase = 'reaction') AS react FROM moments_v),
  a AS (SELECT *, least(end_ms, greatest(start_ms, origin_ms)) AS o,
     least(end_ms, greatest(start_ms, coalesce(contact_ms, start_ms + CAST(floor(len * CASE WHEN react THEN 18 ELSE 34 END / 100) AS BIGINT)))) AS c,
     least(end_ms, greatest(start_ms, coalesce(flight_ms, start_ms + CAST(floor(len * 38 / 100) AS BIGINT)))) AS f0,
     least(end_ms, greatest(start_ms, coalesce(handoff_ms, start_ms + CAST(floor(len * 50 / 100) AS BIGINT)))) AS h0,
     least(end_ms, greatest(start_ms, payoff_start_ms)) AS s0, least(end_ms, greatest(start_ms, payoff_end_ms)) AS e0 FROM p)
  SELECT moment_id, o AS origin_ms, c AS contact_ms, greatest(o, f0) AS flight_ms, greatest(o, f0, h0) AS handoff_ms,
    greatest(c, o, f0, h0, s0) AS payoff_start_ms, greatest(c, o, f0, h0, s0, e0) AS payoff_end_ms,
    CASE WHEN camera_mode <> 'drone' THEN camera_mode WHEN react THEN 'reaction' WHEN event_type = 'goal' THEN 'goal_hold' ELSE 'joint_follow' END AS camera_mode, n0 AS annotation_start_ms,
    CASE WHEN event_type = 'goal' AND annotation_end_ms IS NULL THEN least(end_ms, c + 450) ELSE greatest(n0, least(c + 650, least(end_ms, greatest(start_ms, coalesce(annotation_end_ms, start_ms + CAST(floor(len * 42 / 100) AS BIGINT)))))) END AS annotation_end_ms
  FROM (SELECT *, CASE WHEN event_type = 'goal' AND annotation_start_ms IS NULL THEN greatest(start_ms, c - 1200) ELSE least(end_ms, greatest(start_ms, coalesce(annotation_start_ms, start_ms + CAST(floor(len * 8 / 100) AS BIGINT)))) END AS n0 FROM a)""")
def _(v):
    return M.normalize_brief(v.moments.selectExpr("*", *NOTED)).select("moment_id", *M.PHASE_CLOCKS[:6], "camera_mode", "annotation_start_ms", "annotation_end_ms")


WINDOW_SQL = """w AS (SELECT *, greatest(start_ms, proof_start_ms) AS lo, least(end_ms, proof_end_ms) AS hi,
    proof_verified AND proof_event = event_type AND box_x1 < box_x2 AND box_y1 < box_y2 AND box_x2 <= 1 AND box_y2 <= 1
      AND least(end_ms, proof_end_ms) - greatest(start_ms, proof_start_ms) >= 500 AS ok FROM moments_v)"""


@query("payoff_window", f"WITH {WINDOW_SQL} SELECT moment_id, CASE WHEN ok THEN lo END AS window_start_ms, CASE WHEN ok THEN hi END AS window_end_ms FROM w")
def _(v):
    return M.payoff_window(v.moments).select("moment_id", "window_start_ms", "window_end_ms")


@query("orient_payoff_box", f"""WITH {WINDOW_SQL}, f AS (SELECT *, ok AND event_type = 'goal' AS g, ok AND event_type = 'goal' AND ((attack_direction = 'right' AND (box_x1 + box_x2) / 2 < 0.45e0)
    OR (attack_direction = 'left' AND (box_x1 + box_x2) / 2 > 0.55e0)) AS flip FROM w)
  SELECT moment_id, CASE WHEN flip THEN 1 - box_x2 ELSE box_x1 END AS box_x1, CASE WHEN flip THEN 1 - box_x1 ELSE box_x2 END AS box_x2,
    CASE WHEN g THEN CASE WHEN flip THEN 1 - (box_x1 + box_x2) / 2 ELSE (box_x1 + box_x2) / 2 END
      WHEN goal_focus_x IS NOT NULL THEN least(1, greatest(0, goal_focus_x)) END AS focus_x FROM f""")
def _(v):
    return M.orient_payoff_box(v.moments).select("moment_id", "box_x1", "box_x2", "focus_x")


@query("to_scene_clock", """SELECT moment_id, origin_ms - start_ms AS origin_loc_ms, contact_ms - start_ms AS contact_loc_ms, flight_ms - start_ms AS flight_loc_ms,
   handoff_ms - start_ms AS handoff_loc_ms, payoff_start_ms - start_ms AS payoff_start_loc_ms, payoff_end_ms - start_ms AS payoff_end_loc_ms,
   proof_start_ms - start_ms AS proof_start_loc_ms, proof_end_ms - start_ms AS proof_end_loc_ms, end_ms - start_ms AS length_ms FROM moments_v""")
def _(v):
    out = M.to_scene_clock(v.moments)
    return out.select("moment_id", *[c for c in out.columns if c.endswith("_loc_ms")], "length_ms")


PHASED = ["*", "900L + 20 * (k % 10) AS contact_ms", "CASE WHEN scene_id % 2 = 0 THEN 700L ELSE 1300L END AS flight_ms", "2100L AS payoff_ms"]


@query("action_phase", """SELECT match_id, scene_id, frame, CASE WHEN t_ms >= 2100 THEN 'payoff'
    WHEN f < c THEN CASE WHEN t_ms < f THEN 'setup' WHEN t_ms BETWEEN c - 150 AND c + 120 THEN 'contact' ELSE 'flight' END
    WHEN t_ms < c THEN 'setup' WHEN t_ms < f THEN 'contact' ELSE 'flight' END AS action_phase
  FROM (SELECT *, 900 + 20 * (k % 10) AS c, CASE WHEN scene_id % 2 = 0 THEN 700 ELSE 1300 END AS f FROM frames_v)""")
def _(v):
    return M.action_phase(v.frames.selectExpr(*PHASED)).select("match_id", "scene_id", "frame", "action_phase")


@query("select_masks", """SELECT m.match_id, m.moment_id, k.mask_id FROM moments_v m JOIN masks_v k ON k.match_id = m.match_id
   AND k.mask_confidence >= 0.72e0 AND k.first_ms < m.end_ms AND k.last_ms > m.start_ms""")
def _(v):
    return M.select_masks(v.moments, v.masks).select("match_id", "moment_id", "mask_id")


@query("duration_bounds", """SELECT match_id, duration_ms, 0::BIGINT AS min_ms,
   CASE WHEN duration_ms <= 300000 THEN least(90000, duration_ms) WHEN duration_ms <= 420000 THEN 120000 WHEN duration_ms <= 900000 THEN 240000 ELSE 300000 END AS max_ms,
   CASE WHEN duration_ms < 180000 THEN 'shorter_than_three_minutes' END AS problem
  FROM (SELECT match_id, count(*) * 9000 AS duration_ms FROM moments_v GROUP BY match_id)""")
def _(v):
    return M.duration_bounds(v.moments.groupBy("match_id").agg((F.count(F.lit(1)) * 9000).alias("duration_ms")))


@query("candidate_state", f"SELECT moment_id, {S.coverage_state_sql()} AS state FROM moments_v")
def _(v):
    return v.moments.select("moment_id", S.candidate_state().alias("state"))


@query("buildup_eligible", """SELECT moment_id FROM moments_v WHERE additional_action AND event_type IN ('normal_play', 'assist', 'dribble') AND semantic_verified AND action_complete
   AND keep_decision <> 'reject' AND ball_visible IS NOT FALSE AND player_visible IS NOT FALSE AND visual_clarity >= 70 AND ordinal % 3 <> 1 AND ordinal % 5 <> 2
   AND origin_ms BETWEEN start_ms AND end_ms AND contact_ms BETWEEN start_ms AND end_ms AND payoff_end_ms BETWEEN start_ms AND end_ms
   AND origin_ms < contact_ms AND contact_ms < payoff_end_ms""")
def _(v):
    rich = v.moments.selectExpr("*", "CASE WHEN ordinal % 3 = 1 THEN 1 ELSE 3 END AS fact_count",
                                "CASE WHEN ordinal % 5 = 2 THEN array('setup', 'flight') ELSE array('setup', 'payoff') END AS ball_phases")
    return M.buildup_eligible(rich).where("buildup_eligible").select("moment_id")


@query("static_fallback", """WITH h AS (SELECT *, keep_decision = 'reject' AND semantic_verified IS TRUE AND action_complete IS TRUE
     AND (event_type = 'celebration' OR story_phase = 'reaction') AND player_visible IS TRUE AND confidence >= 0.84e0 AND visual_clarity >= 70 AS hit,
     (is_replay OR story_phase = 'replay') AS rep FROM moments_v)
  SELECT moment_id, hit AS static_view, CASE WHEN hit THEN CASE WHEN rep THEN 'replay' ELSE 'keep' END ELSE keep_decision END AS keep_decision,
    CASE WHEN hit THEN 'safe_static_' || coalesce(tracking_decision, 'tracking_unavailable') ELSE tracking_decision END AS tracking_decision,
    CASE WHEN NOT hit THEN reject_reason END AS reject_reason,
    CASE WHEN hit THEN CASE WHEN effect = 'freeze_analysis' THEN effect WHEN rep THEN 'replay_treatment'
      WHEN event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance') THEN 'slow_motion' ELSE 'none' END ELSE effect END AS effect FROM h""")
def _(v):
    return M.static_fallback(v.moments).select("moment_id", "static_view", "keep_decision", "tracking_decision", "reject_reason", "effect")


@query("decision_relabel", """WITH h AS (SELECT *, event_type = 'disallowed_goal' AND semantic_verified IS TRUE AND action_complete IS TRUE AND camera_mode = 'reaction'
    AND ordinal % 3 <> 0 AND ordinal % 2 = 1 AS hit FROM moments_v)
  SELECT moment_id, hit AS relabelled, CASE WHEN hit THEN 'var' ELSE event_type END AS event_type, CASE WHEN hit THEN 'reaction' ELSE story_phase END AS story_phase FROM h""")
def _(v):
    rich = v.moments.drop("proof_start_ms").selectExpr(
        "*", "CAST(NULL AS BIGINT) AS proof_start_ms",
        "array(named_struct('phase', 'reaction', 'subjects', array('referee', CASE WHEN ordinal % 3 = 0 THEN 'ball' ELSE 'bench' END))) AS required",
        "array('crowd waits', CASE WHEN ordinal % 2 = 1 THEN 'Referee checks the monitor' ELSE 'players argue' END) AS facts")
    return M.decision_relabel(rich).select("moment_id", "relabelled", "event_type", "story_phase")


@query("cap_reactions", """SELECT moment_id, CASE WHEN free THEN least(end_ms, start_ms + 3000) ELSE end_ms END AS end_ms, CASE WHEN free THEN 1e0 ELSE playback_rate END AS playback_rate
  FROM (SELECT *, (event_type = 'celebration' OR story_phase = 'reaction') AND selection_locked IS NOT TRUE AS free FROM moments_v)""")
def _(v):
    return M.cap_reactions(v.moments).select("moment_id", "end_ms", "playback_rate")


JOBS = ["match_id", "CASE duration_ms % 4 WHEN 0 THEN 'viral_reel' WHEN 1 THEN 'tactical_analysis' WHEN 2 THEN 'slideshow' END AS edit_style",
        "CASE duration_ms % 5 WHEN 0 THEN 'loud' WHEN 1 THEN 'muted' END AS original_audio",
        "CASE duration_ms % 7 WHEN 0 THEN 'frantic' WHEN 1 THEN 'natural' END AS intensity",
        "CASE duration_ms % 3 WHEN 0 THEN '1:1' WHEN 1 THEN '21:9' END AS aspect_ratio"]


@query("validate_settings", f"""WITH j AS (SELECT {', '.join(JOBS)} FROM (SELECT match_id, count(*) AS duration_ms FROM moments_v GROUP BY match_id)),
  d AS (SELECT match_id, coalesce(edit_style, 'complete_highlights') AS edit_style, coalesce(original_audio, 'reduced') AS original_audio, coalesce(intensity, 'dynamic') AS intensity, aspect_ratio FROM j)
  SELECT match_id, edit_style, original_audio, intensity, CASE WHEN edit_style = 'viral_reel' THEN '4:5' WHEN aspect_ratio = '1:1' THEN '1:1' ELSE '9:16' END AS aspect_ratio,
   CASE WHEN original_audio = 'loud' THEN 'INVALID_AUDIO_MODE' WHEN intensity = 'frantic' THEN 'INVALID_INTENSITY' WHEN edit_style = 'slideshow' THEN 'INVALID_EDIT_STYLE' END AS problem,
   CASE edit_style WHEN 'viral_reel' THEN 36 WHEN 'complete_highlights' THEN 60 ELSE 0 END AS target_s,
   CASE edit_style WHEN 'viral_reel' THEN 30 WHEN 'complete_highlights' THEN 60 ELSE 0 END AS min_s FROM d""")
def _(v):
    jobs = v.moments.groupBy("match_id").agg(F.count(F.lit(1)).alias("duration_ms")).selectExpr(*JOBS)
    return M.validate_settings(jobs)


PROBE = "CASE WHEN ordinal % 9 = 0 THEN 0 ELSE end_ms - start_ms + (ordinal % 5) * 60 - 60 END"


@query("media_preflight", f"""SELECT match_id, moment_id, CASE WHEN m <= 0 OR m IS NULL THEN 'invalid_rendered_crop_media' WHEN abs(m - len) > greatest(100e0, 2000e0 / fps) THEN 'rendered_crop_duration_mismatch' END AS issue,
    NOT (m <= 0 OR m IS NULL OR abs(m - len) > greatest(100e0, 2000e0 / fps)) AS usable
  FROM (SELECT match_id, moment_id, end_ms - start_ms AS len, CASE WHEN ordinal % 10 <> 7 THEN {PROBE} END AS m, CASE WHEN ordinal % 2 = 0 THEN 12e0 ELSE 25e0 END AS fps FROM moments_v)""")
def _(v):
    probes = v.moments.where("ordinal % 10 <> 7").selectExpr("match_id", "moment_id", f"{PROBE} AS media_ms", "CASE WHEN ordinal % 2 = 0 THEN 12e0 ELSE 25e0 END AS fps")
    return M.media_preflight(v.moments.select("match_id", "moment_id", "start_ms", "end_ms"), probes)
