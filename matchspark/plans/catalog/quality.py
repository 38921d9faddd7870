"""Queries measuring scenes and turning measurements into verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import quality as Q
from matchspark.operators import windows as W
from matchspark.plans.catalog.intervals import PLAN_SQL, src
from matchspark.plans.catalog.linking import GUIDE_SQL, guided
from matchspark.plans.registry import query

LIVE = "NOT (is_replay OR story_phase = 'replay')"
REACT = "(event_type = 'celebration' OR story_phase = 'reaction')"
REP = r"regexp_matches(reason, 'framing|camera|ball|goal_action|action_phases|keyframe_(opening|contact|ball_flight|payoff)')"


@query("evidence_report", f"""WITH b AS (SELECT match_id, moment_id, semantic_verified, 'rejected' AS state, coalesce(reject_reason, tracking_decision, 'analysis_rejected') AS reason FROM moments_v WHERE keep_decision = 'reject'
   UNION ALL SELECT match_id, moment_id, semantic_verified, 'framing_pending', coalesce(tracking_decision, 'unverified_framing') FROM moments_v WHERE selection_locked AND tracking_passed IS FALSE)
  SELECT match_id, moment_id, state, reason, coalesce(semantic_verified, false) AND {REP} AS repairable FROM b""")
def _(v):
    return Q.evidence_report(v.moments)


TE = ["match_id", "CASE WHEN ordinal % 9 <> 0 THEN 20 + ordinal % 70 END AS frames"] + [f"CASE WHEN ordinal % {7 + i} <> 1 THEN ((ordinal * {13 + i}) % 100) / 128e0 END AS {c}" for i, c in enumerate(Q.COVERAGES)]


@query("tracking_summary", f"""WITH e AS (SELECT {', '.join(TE)} FROM moments_v) SELECT match_id, CAST(sum(coalesce(frames, 0)) AS BIGINT) AS frames, {', '.join(f'round(sum(coalesce({c}, 0) * coalesce(frames, 0)) / greatest(1, sum(coalesce(frames, 0))) + 1e-9, 4) AS {c}' for c in Q.COVERAGES)} FROM e GROUP BY match_id""")
def _(v):
    return Q.tracking_summary(v.moments.selectExpr(*TE))


R = lambda c, f="true": f"round(coalesce(count(*) FILTER (({c}) AND ({f})), 0) / greatest(1, count(*) FILTER ({f})) + 1e-9, 4)"


@query("phase_quality", f"""WITH k AS (SELECT *, phase AS judged FROM frames_v WHERE phase IN ('setup', 'flight', 'payoff') UNION ALL SELECT *, 'contact' FROM frames_v WHERE t_ms BETWEEN 1500 - 300 AND 1500 + 250)
  SELECT match_id, scene_id, judged, count(*) AS samples, {R('direct AND ball_in_frame')} AS direct_ball, {R('ball_in_frame')} AS ball, {R('joint_fit')} AS joint, {R('direct AND joint_fit')} AS direct_joint, {R('payoff_in_frame')} AS payoff FROM k GROUP BY ALL""")
def _(v):
    return Q.phase_quality(v.frames, F.lit(1500))


GAP_SQL = """st AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER w, 100) AS step, count(*) FILTER (direct) OVER w AS run FROM frames_v WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  gp AS (SELECT match_id, scene_id, max(g) AS gap_ms FROM (SELECT match_id, scene_id, run, CAST(sum(CASE WHEN direct THEN 0 ELSE step END) AS BIGINT) AS g FROM st GROUP BY ALL) GROUP BY ALL)"""
CAM_SQL = """mv AS (SELECT *, CASE WHEN NOT cut THEN camera_x - lag(camera_x) OVER w END AS mv FROM frames_v WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  jk AS (SELECT *, abs(mv - lag(mv) OVER (PARTITION BY match_id, scene_id ORDER BY t_ms)) AS jerk FROM mv),
  cm AS (SELECT match_id, scene_id, round(coalesce(max(abs(mv)), 0) + 1e-9, 4) AS max_step, round(coalesce(quantile_cont(abs(mv), 0.95), 0) + 1e-9, 4) AS step_p95, round(coalesce(quantile_cont(jerk, 0.95), 0) + 1e-9, 4) AS jerk_p95 FROM jk GROUP BY ALL)"""


@query("longest_gap", f"WITH {GAP_SQL} SELECT * FROM gp")
def _(v):
    return Q.longest_gap(v.frames)


@query("camera_metrics", f"WITH {CAM_SQL} SELECT * FROM cm")
def _(v):
    return Q.camera_metrics(v.frames)


@query("camera_reversals", f"""WITH {CAM_SQL}, s AS (SELECT *, sign(mv) <> lag(sign(mv)) OVER (PARTITION BY match_id, scene_id ORDER BY t_ms) AS turn FROM mv WHERE abs(mv) >= 0.01e0)
  SELECT match_id, scene_id, count(*) AS moves, count(*) FILTER (turn) AS reversals, round(count(*) FILTER (turn) / greatest(1, count(*) - 1) + 1e-9, 4) AS rate, count(*) FILTER (abs(mv) > 0.25e0) AS jumps FROM s GROUP BY ALL""")
def _(v):
    return Q.camera_reversals(v.frames)


HG = ["match_id", "scene_id", "t_ms", "cut", "phase", "direct", "ball_x", "ball_y", "track_id", "px - 0.02e0 AS px1", "px + 0.02e0 AS px2", "ptop", "pbottom", "0.4e0 + ((match_id * 7 + scene_id * 3 + t_ms * (match_id % 3)) % 1000) / 8192e0 AS camera_x",
      "CASE WHEN ordinal % 4 = 0 THEN 0e0 ELSE 0.01e0 END AS x0", "0e0 AS y0", "CASE WHEN ordinal % 3 = 0 THEN 1e0 ELSE 0.99e0 END AS x1", "1e0 AS y1", "CAST(1200 AS BIGINT) AS contact_ms", "CAST(2200 AS BIGINT) AS payoff_start_ms", "CAST(2900 AS BIGINT) AS payoff_end_ms", "match_id % 5 = 0 AS support_only"]


@query("hybrid_geometry", f"""WITH h AS (SELECT {', '.join(HG)} FROM frames_v), i AS (SELECT *, coalesce(direct AND ball_x BETWEEN x0 + CASE WHEN x0 <= 0.000001e0 THEN 0 ELSE 0.008e0 END AND x1 - CASE WHEN x1 >= 0.999999e0 THEN 0 ELSE 0.008e0 END AND ball_y BETWEEN y0 AND y1, false) AS ball,
    coalesce(track_id IS NOT NULL AND px1 >= x0 + CASE WHEN x0 <= 0.000001e0 THEN 0 ELSE 0.008e0 END AND px1 <= x1 - CASE WHEN x1 >= 0.999999e0 THEN 0 ELSE 0.008e0 END AND px2 >= x0 + CASE WHEN x0 <= 0.000001e0 THEN 0 ELSE 0.008e0 END AND px2 <= x1 - CASE WHEN x1 >= 0.999999e0 THEN 0 ELSE 0.008e0 END AND ptop >= y0 AND pbottom <= y1, false) AS man,
    coalesce(NOT cut AND abs(camera_x - lag(camera_x) OVER w) / ((t_ms - lag(t_ms) OVER w) / 1000) > 0.352e0, false) AS fast, t_ms BETWEEN 900 AND 1450 AS nr, t_ms BETWEEN 2200 AND 2900 AS pp FROM h WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  g AS (SELECT match_id, scene_id, bool_or(direct AND NOT ball) AS off_crop, bool_or(fast) AS fast, bool_or(support_only) AS sup, bool_or(t_ms <= 800 AND ball AND man) AS opening, count(*) FILTER (nr) AS cn, count(*) FILTER (phase = 'setup') AS sn, count(*) FILTER (phase = 'flight') AS fn, count(*) FILTER (pp) AS pn,
    {', '.join(f"count(*) FILTER (ball AND {c}) / greatest(1, count(*) FILTER ({c})) AS {p}_ball, count(*) FILTER (ball AND man AND {c}) / greatest(1, count(*) FILTER ({c})) AS {p}_joint" for p, c in dict(setup="phase = 'setup'", contact="nr", flight="phase = 'flight'", payoff="pp").items())} FROM i GROUP BY ALL)
  SELECT match_id, scene_id, NOT off_crop AND NOT fast AS usable, array_to_string([x FOR x IN [CASE WHEN off_crop THEN 'observed_ball_outside_safe_crop' END, CASE WHEN fast THEN 'within_shot_camera_speed_exceeded' END, CASE WHEN NOT sup AND NOT opening THEN 'opening_carrier_and_ball_missing' END,
    CASE WHEN NOT sup AND (cn = 0 OR contact_joint < 0.5e0) THEN 'contact_carrier_and_ball_unverified' END, CASE WHEN NOT sup AND sn > 0 AND setup_joint < 0.5e0 THEN 'setup_carrier_and_ball_unverified' END, CASE WHEN NOT sup AND fn > 0 AND flight_ball < 0.5e0 THEN 'ball_flight_unverified' END,
    CASE WHEN NOT sup AND (pn = 0 OR payoff_ball < 0.4e0) THEN 'resolved_action_ball_unverified' END] IF x IS NOT NULL], ',') AS issues, {', '.join(f'round({p}_ball + 1e-9, 4) AS {p}_ball, round({p}_joint + 1e-9, 4) AS {p}_joint' for p in ('setup', 'contact', 'flight', 'payoff'))} FROM g""")
def _(v):
    return Q.hybrid_geometry(v.frames.selectExpr(*HG))


PPL = "match_id, scene_id, frame, t_ms, idx, track_id % 3 AS track_id, 0.3e0 + cx / 4 - (idx % 3) / 40e0 AS x1, 0.3e0 + cx / 4 + 0.02e0 + (ordinal % 7) / 64e0 AS x2, y1, y2, shot_no"


@query("decision_subject", f"""WITH sh AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, scene_id ORDER BY frame) AS BIGINT) AS shot_no FROM frames_v),
  p AS (SELECT {PPL} FROM players_v JOIN (SELECT match_id, scene_id, frame, shot_no FROM sh) USING (match_id, scene_id, frame)),
  q AS (SELECT match_id, scene_id, shot_no, track_id, count(*) AS n, arg_min(y2 - y1, struct_pack(t := t_ms, i := idx)) AS h, min(struct_pack(t := t_ms, i := idx)) AS f, list_sort(list((x1 + x2) / 2)) AS xs FROM p GROUP BY ALL),
  d AS (SELECT *, least(1 - 0.16e0, greatest(0.16e0, xs[len(xs) // 2 + 1])) AS c FROM q QUALIFY row_number() OVER (PARTITION BY match_id, scene_id, shot_no ORDER BY n DESC, h DESC, f.t, f.i) = 1),
  b AS (SELECT match_id, scene_id, shot_no, frame, track_id, arg_min(struct_pack(x1 := x1, x2 := x2, y1 := y1, y2 := y2), idx) AS b FROM p GROUP BY ALL),
  r AS (SELECT sh.match_id, sh.scene_id, coalesce(b.x1 >= c - 0.16e0 + 0.005e0 AND b.x2 <= c + 0.16e0 - 0.005e0 AND b.y1 >= 0 AND b.y2 <= 1, false) AS ok FROM sh LEFT JOIN d USING (match_id, scene_id, shot_no) LEFT JOIN b ON b.match_id = sh.match_id AND b.scene_id = sh.scene_id AND b.shot_no = sh.shot_no AND b.frame = sh.frame AND b.track_id = d.track_id)
  SELECT match_id, scene_id, round(count(*) FILTER (ok) / count(*) + 1e-9, 4) AS coverage, count(*) FILTER (ok) / count(*) >= 0.8e0 AS verified FROM r GROUP BY ALL""")
def _(v):
    shot = "CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, scene_id ORDER BY frame) AS BIGINT) AS shot_no"
    sh = v.frames.selectExpr("match_id", "scene_id", "frame", shot)
    people = v.players.join(sh, ["match_id", "scene_id", "frame"]).selectExpr(*[c.strip() for c in PPL.split(", ")])
    return Q.decision_subject(people, sh, 0.32)


PPX = "match_id, scene_id, {o} AS origin_ms, scene_id % 2 = 1 AS replay, match_id % 3 = 0 AS goal, match_id % 7 = 6 AS player_only"
PKX = ["match_id", "scene_id", "t_ms", "phase", "direct", "ball_in_frame", "player_in_frame", "joint_fit OR k % 2 = 0 AS joint_fit", "payoff_in_frame", "k % 3 = 0 AS guided", "k % 41 = 5 AS marker"]


@query("phase_problems", f"""WITH r AS MATERIALIZED (SELECT f.*, origin_ms, replay, goal FROM (SELECT {', '.join(PKX)} FROM frames_v) f JOIN (SELECT DISTINCT {PPX.format(o='match_id % 4 * 200')} FROM frames_v) s USING (match_id, scene_id) WHERE NOT player_only),
  l AS (SELECT *, ball_in_frame AND player_in_frame AND joint_fit AND direct AS dj, replay AND guided AND ball_in_frame AND player_in_frame AND joint_fit AS gj, row_number() OVER w AS n, phase IN ('setup', 'contact') AS o FROM r WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  c AS (SELECT *, coalesce(min(n) FILTER (phase = 'contact') OVER s, 1) AS at0, count(*) FILTER (phase = 'contact') OVER s AS nc, count(*) FILTER (o) OVER s AS no, count(*) FILTER (o AND t_ms >= greatest(0, origin_ms - 120)) OVER s AS nl FROM l WINDOW s AS (PARTITION BY match_id, scene_id)),
  a AS (SELECT *, CASE WHEN replay THEN gj ELSE dj END AS lk, row_number() OVER w AS k FROM c WHERE CASE WHEN nl >= least(3, no) THEN o AND t_ms >= greatest(0, origin_ms - 120) ELSE o END WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  f AS (SELECT *, count(*) FILTER (lk) OVER w AS s5, count(*) OVER w AS c5, max(t_ms) OVER w AS l5 FROM a WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
  op AS (SELECT match_id, scene_id, bool_or((k = 1 AND s5 / c5 >= 0.6e0) OR (c5 = 5 AND s5 >= 3 AND l5 <= origin_ms + 1050)) AS opened FROM f GROUP BY ALL),
  g AS (SELECT match_id, scene_id, bool_or(n >= at0 - 5 AND n < at0 + greatest(5, nc + 4) AND o AND (dj OR gj)) AS pre, bool_or(n >= at0 - 5 AND n < at0 + greatest(5, nc + 4) AND phase IN ('contact', 'flight') AND direct AND ball_in_frame) AS post,
    count(*) FILTER (phase = 'flight') AS fn, count(*) FILTER (phase = 'flight' AND ball_in_frame AND (direct OR guided)) AS fy, count(*) FILTER (phase = 'payoff') AS pn,
    count(*) FILTER (phase = 'payoff' AND ((direct AND ball_in_frame) OR payoff_in_frame OR (replay AND guided AND ball_in_frame))) AS py0, bool_or(phase IN ('flight', 'payoff') AND marker) AS lm, bool_or(goal) AS goal FROM c GROUP BY ALL)
  SELECT match_id, scene_id, array_to_string([x FOR x IN [CASE WHEN NOT coalesce(opened, false) THEN 'opening_player_ball_not_locked' END, CASE WHEN NOT pre OR NOT post THEN 'contact_keyframes_incomplete' END, CASE WHEN fn > 0 AND fy / fn < 0.75e0 THEN 'ball_flight_keyframes_incomplete' END,
    CASE WHEN pn = 0 OR py0 / pn < CASE WHEN goal THEN 0.5e0 ELSE 0.2e0 END THEN 'payoff_keyframes_incomplete' END, CASE WHEN lm THEN 'player_marker_continues_after_contact' END] IF x IS NOT NULL], ',') AS problems FROM g LEFT JOIN op USING (match_id, scene_id)""")
def _(v):
    scenes = v.frames.select("match_id", "scene_id").distinct().selectExpr(*PPX.format(o="match_id % 4 * 200").split(", "))
    return Q.phase_problems(v.frames.selectExpr(*PKX), scenes)


SM = ["*", "((ordinal * 3) % 100) / 256e0 AS spread", "CAST(4 + ordinal % 37 AS DOUBLE) AS ball_px"]


@query("scene_metrics", f"""WITH {GAP_SQL}, {CAM_SQL}, m AS (SELECT match_id, scene_id, count(*) AS frames, {R('direct')} AS ball_cov, {R('track_id IS NOT NULL')} AS player_cov, {R('joint_fit')} AS joint_fit_cov, {R('subject_confidence >= 0.48e0')} AS lock_cov, {R('possession')} AS possession_cov,
   {R('ball_in_frame AND direct', "phase IN ('setup', 'contact', 'flight')")} AS action_ball, round(coalesce(quantile_cont(((ordinal * 3) % 100) / 256e0, 0.9) FILTER ((ordinal * 3) % 100 > 0), 0) + 1e-9, 4) AS spread_p90, round(coalesce(median(CAST(4 + ordinal % 37 AS DOUBLE)) FILTER (direct), 0), 2) AS ball_px_median,
   match_id % 2 = 0 AS goal, count(*) FILTER (joint_fit AND direct AND phase IN ('setup', 'contact')) / greatest(1, count(*) FILTER (phase IN ('setup', 'contact'))) AS o, count(*) FILTER (ball_in_frame AND direct AND phase = 'flight') / greatest(1, count(*) FILTER (phase = 'flight')) AS f, count(*) FILTER (phase = 'flight') AS fn,
   count(*) FILTER (payoff_in_frame AND phase = 'payoff') / greatest(1, count(*) FILTER (phase = 'payoff')) AS p, count(*) FILTER (joint_fit AND direct AND t_ms BETWEEN 1200 AND 1750) / greatest(1, count(*) FILTER (t_ms BETWEEN 1200 AND 1750)) AS c FROM frames_v GROUP BY ALL)
  SELECT m.match_id, m.scene_id, frames, ball_cov, player_cov, joint_fit_cov, lock_cov, possession_cov, action_ball, spread_p90, ball_px_median, round(CASE WHEN goal THEN o ELSE 1 END + 1e-9, 4) AS goal_origin, round(CASE WHEN goal THEN f ELSE 1 END + 1e-9, 4) AS goal_flight, round(CASE WHEN goal THEN p ELSE 1 END + 1e-9, 4) AS goal_payoff,
   NOT goal OR (round(c + 1e-9, 4) >= 0.35e0 AND o >= 0.5e0 AND (fn = 0 OR f >= 0.35e0) AND p >= 0.5e0) AS action_complete, gap_ms, max_step, step_p95, jerk_p95 FROM m JOIN gp USING (match_id, scene_id) JOIN cm USING (match_id, scene_id)""")
def _(v):
    return Q.scene_metrics(v.frames.selectExpr(*SM), F.lit(1500), F.col("match_id") % 2 == 0)


ph = lambda p, m: [f"(ordinal * {m}) % 12 AS {p}_n", *[f"((ordinal * {m + 2 + i}) % 33) / 32e0 AS {p}_{c}" for i, c in enumerate(("ball", "direct_ball", "joint", "direct", "payoff"))]]
WIDE = ["match_id", "moment_id", "event_type", "story_phase", "is_replay", "semantic_verified", "action_complete", "ball_visible", "player_visible", "0.82e0 + confidence / 8 AS confidence", "visual_clarity", "camera_mode",
        "CASE WHEN ordinal % 6 = 0 THEN 30 WHEN ordinal % 6 < 5 THEN 40 END AS frames", *[c.replace(f"(ordinal * {m}) % 12 AS {p}_n", f"CASE WHEN ordinal % 4 <> 1 THEN (ordinal * {m}) % 12 END AS {p}_n") for p, m in (("setup", 5), ("contact", 7), ("flight", 11), ("payoff", 13)) for c in ph(p, m)],
        "((ordinal * 17) % 41) / 40e0 AS ball_cov", "0.6e0 + ((ordinal * 19) % 41) / 100e0 AS player_cov", "0.5e0 + ((ordinal * 23) % 51) / 100e0 AS joint_vis", "0.4e0 + ((ordinal * 29) % 61) / 100e0 AS joint_fit_cov",
        "((ordinal * 31) % 48) / 10e0 AS gap_s", "((ordinal * 37) % 33) / 32e0 AS goal_payoff", "((ordinal * 41) % 33) / 100e0 AS max_step", "((ordinal * 43) % 7) / 100e0 AS step_p95", "((ordinal * 47) % 5) / 100e0 AS jerk_p95",
        "((ordinal * 53) % 21) / 100e0 AS reversal_rate", "ordinal % 3 AS jumps", "ordinal % 9 AS moves", "ordinal % 5 = 2 AS declared_cut", "((ordinal * 59) % 33) / 32e0 AS action_ball", "CASE ordinal % 3 WHEN 0 THEN false WHEN 1 THEN true END AS ev_complete",
        "CASE WHEN ordinal % 8 = 3 THEN 'contact_keyframes_incomplete,payoff_keyframes_incomplete' ELSE '' END AS problems", "ordinal % 7 = 1 AS opening", "ordinal % 29 = 4 AS full_bleed_repair", "1 + ordinal % 2 AS metrics_version", "ordinal % 3 = 1 AS final_crop_verified"]
WIDE_SQL = f"w0 AS (SELECT {', '.join(WIDE)} FROM moments_v)"


@query("native_verdict", f"""WITH {WIDE_SQL}, z AS (SELECT *, {REACT} AS react, setup_n > 0 AND setup_ball >= 0.75e0 AND (setup_direct >= 0.3e0 OR player_cov >= 0.65e0) AS su, contact_n > 0 AND ((contact_ball >= 0.75e0 AND contact_direct >= 0.4e0)
    OR (setup_direct >= 0.55e0 AND contact_ball >= 0.25e0 AND contact_payoff >= 0.4e0 AND (flight_ball >= 0.35e0 OR flight_payoff >= 0.55e0))) AS co, flight_n > 0 AND (flight_ball >= 0.4e0 OR flight_payoff >= 0.5e0) AS fl, payoff_n > 0 AND (payoff_payoff >= 0.5e0 OR payoff_ball >= 0.4e0) AS pa FROM w0),
  m AS (SELECT moment_id, CASE WHEN react THEN 'planned_reaction' WHEN setup_n IS NULL OR semantic_verified IS NOT TRUE OR action_complete IS FALSE OR ball_visible IS FALSE OR player_visible IS FALSE THEN 'native_action_evidence_missing' WHEN NOT su THEN 'native_setup_evidence_incomplete'
    WHEN NOT co THEN 'native_contact_evidence_incomplete' WHEN NOT fl THEN 'native_flight_evidence_incomplete' WHEN event_type IN ('goal', 'shot_on_target', 'shot_off_target', 'save', 'big_chance') AND NOT pa THEN 'native_payoff_evidence_incomplete'
    WHEN event_type = 'goal' THEN 'native_frame_verified_goal' ELSE 'native_frame_verified_action' END AS mode FROM z)
  SELECT moment_id, mode, mode IN ('planned_reaction', 'native_frame_verified_goal', 'native_frame_verified_action') AS usable FROM m""")
def _(v):
    return Q.native_verdict(v.moments.selectExpr(*WIDE)).select("moment_id", "mode", "usable")


LEAST = lambda c, t, n: f"(coalesce({c}, 0) >= {t} OR (coalesce({n}, 0) >= 4 AND coalesce({c}, 0) + 1e0 / greatest({n}, 1) >= {t}))"


@query("framing_verdict", f"""WITH {WIDE_SQL}, n AS (SELECT * REPLACE (coalesce(setup_n, 0) AS setup_n, coalesce(contact_n, 0) AS contact_n, coalesce(flight_n, 0) AS flight_n, coalesce(payoff_n, 0) AS payoff_n), setup_n IS NOT NULL AS phased FROM w0),
  a AS (SELECT *, event_type IN ('goal', 'disallowed_goal') AS goal, semantic_verified IS TRUE AND action_complete IS TRUE AS sem, ball_visible IS TRUE AND player_visible IS TRUE AS seen, is_replay OR story_phase = 'replay' AS rep FROM n),
  b AS (SELECT *, joint_fit_cov >= 0.7e0 OR (goal AND sem AND joint_fit_cov >= 0.55e0) AS fit FROM a),
  c AS (SELECT *, step_p95 <= CASE WHEN declared_cut THEN 0.055e0 ELSE 0.03e0 END AND fit AND (max_step <= 0.25e0 OR (jumps <= 1 AND jerk_p95 <= 0.02e0 AND (declared_cut OR step_p95 <= 0.03e0))) AS iso FROM b),
  d AS (SELECT *, (moves >= 4 AND reversal_rate <= 0.1e0 AND max_step <= 0.3e0 AND step_p95 <= 0.065e0 AND fit) OR (sem AND moves >= 4 AND reversal_rate <= 0.1e0 AND max_step <= 0.12e0 AND step_p95 <= 0.055e0 AND jerk_p95 <= 0.04e0 AND joint_fit_cov >= 0.45e0 AND ball_cov >= 0.45e0 AND player_cov >= 0.85e0)
      OR ((NOT phased OR max_step <= 0.055e0 OR iso) AND (step_p95 <= 0.03e0 OR iso) AND (jerk_p95 <= 0.02e0 OR iso)) AS stable,
      goal AND phased AND sem AND setup_direct >= 0.55e0 AND contact_ball >= 0.25e0 AND contact_payoff >= 0.4e0 AND payoff_payoff >= 0.5e0 AND goal_payoff >= 0.5e0 AS touch FROM c),
  e AS (SELECT *, goal AND phased AND sem AND (contact_direct_ball >= 0.5e0 OR touch) AND (contact_ball >= 0.7e0 OR touch) AND flight_payoff >= 0.55e0 AND payoff_payoff >= 0.5e0 AND goal_payoff >= 0.5e0 AS fly FROM d),
  f AS (SELECT *, goal AND phased AND sem AND seen AND confidence >= 0.9e0 AND {LEAST('setup_direct', '0.55e0', 'setup_n')} AND ({LEAST('contact_direct', '0.35e0', 'contact_n')} OR touch)
      AND (flight_n = 0 OR {LEAST('flight_direct_ball', '0.45e0', 'flight_n')} OR (flight_ball >= 0.6e0 AND action_ball >= 0.8e0) OR fly OR (flight_n <= 8 AND flight_direct_ball >= 0.25e0 AND contact_direct_ball >= 0.5e0 AND goal_payoff >= 0.5e0) OR (flight_n <= 3 AND contact_ball >= 0.5e0 AND payoff_payoff >= 0.5e0))
      AND payoff_n > 0 AND goal_payoff >= 0.5e0 AND ball_cov >= 0.45e0 AND player_cov >= 0.85e0 AND (gap_s <= 3 OR (fly AND gap_s <= 4)) AND stable AS sg,
      rep AND goal AND phased AND sem AND confidence >= 0.9e0 AND {LEAST('setup_ball', '0.85e0', 'setup_n')} AND {LEAST('setup_joint', '0.6e0', 'setup_n')} AND setup_direct >= 0.2e0 AND {LEAST('contact_ball', '0.85e0', 'contact_n')} AND {LEAST('contact_joint', '0.85e0', 'contact_n')} AND contact_direct >= 0.25e0
      AND (flight_n = 0 OR (flight_ball >= 0.9e0 AND flight_direct_ball >= 0.1e0)) AND payoff_n > 0 AND goal_payoff >= 0.5e0 AND action_ball >= 0.9e0 AND ball_cov >= 0.2e0 AND player_cov >= 0.85e0 AND gap_s <= 3 AND stable AS rg,
      goal AND NOT phased AND action_complete IS TRUE AND seen AND confidence >= 0.9e0 AND ball_cov >= 0.65e0 AND player_cov >= 0.85e0 AND joint_vis >= 0.85e0 AND (joint_fit_cov >= 0.7e0 OR (sem AND joint_fit_cov >= 0.6e0)) AND gap_s <= 1.2e0 AND goal_payoff >= 0.5e0 AND stable AS rc FROM e),
  g AS (SELECT *, NOT goal OR ev_complete IS NOT FALSE OR rc OR sg OR rg AS done, CASE WHEN goal THEN CASE WHEN fly OR (ev_complete IS TRUE AND action_ball >= 0.9e0 AND goal_payoff >= 0.75e0) THEN 4e0 ELSE 3e0 END ELSE 2.4e0 END AS allow, NOT goal OR goal_payoff >= 0.1e0 AS ready,
      event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance', 'assist', 'free_kick') AS pact FROM f),
  h AS (SELECT *, sg OR rg OR (NOT goal AND sem AND {LEAST('setup_direct', '0.5e0', 'setup_n')} AND {LEAST('contact_direct', '0.35e0', 'contact_n')} AND (flight_n = 0 OR {LEAST('flight_direct_ball', '0.35e0', 'flight_n')}) AND payoff_n > 0 AND greatest(payoff_ball, payoff_joint, payoff_payoff) >= 0.2e0
        AND ball_cov >= 0.45e0 AND player_cov >= 0.8e0 AND gap_s <= allow AND stable)
      OR (setup_n > 0 AND CASE WHEN rep THEN {LEAST('setup_joint', '0.5e0', 'setup_n')} AND {LEAST('setup_direct', '0.45e0', 'setup_n')} ELSE {LEAST('setup_joint', '0.72e0', 'setup_n')} AND {LEAST('setup_direct', '0.5e0', 'setup_n')} END AND contact_n > 0 AND contact_direct >= 0.35e0
        AND (flight_n = 0 OR (flight_direct_ball >= 0.35e0 AND flight_ball >= 0.75e0)) AND payoff_n > 0 AND CASE WHEN goal THEN goal_payoff >= 0.5e0 ELSE greatest(payoff_direct_ball, payoff_payoff) >= 0.5e0 END) AS complete FROM g),
  i AS (SELECT moment_id, CASE WHEN event_type NOT IN ('goal', 'disallowed_goal', 'offside', 'var', 'save', 'shot_on_target', 'shot_off_target', 'big_chance', 'assist', 'free_kick', 'penalty') AND ({REACT} OR camera_mode = 'reaction') THEN 'planned_reaction' WHEN frames IS NULL THEN 'missing_tracking'
      WHEN full_bleed_repair AND metrics_version >= 2 AND final_crop_verified AND sem AND seen AND confidence >= 0.85e0 AND (NOT goal OR (ev_complete IS TRUE AND action_ball >= 0.9e0 AND goal_payoff >= 0.5e0)) THEN 'full_bleed_repaired'
      WHEN pact AND problems <> '' THEN 'keyframe_contact_keyframes_incomplete' WHEN phased AND pact AND (NOT complete OR NOT done) THEN CASE WHEN goal THEN 'incomplete_goal_action' ELSE 'incomplete_action_phases' END
      WHEN phased AND pact AND NOT stable THEN 'unstable_camera' WHEN phased AND pact AND gap_s > allow THEN 'ball_not_visibly_continuous' WHEN phased AND pact THEN CASE WHEN goal THEN 'phase_verified_goal' ELSE 'phase_verified_action' END
      WHEN (opening OR (ball_cov >= 0.55e0 AND joint_vis >= 0.85e0 AND joint_fit_cov >= 0.78e0 AND gap_s <= 1.2e0)) AND ball_cov >= 0.35e0 AND joint_vis >= 0.72e0 AND joint_fit_cov >= 0.68e0 AND gap_s <= allow AND stable AND ready AND done THEN 'strict'
      WHEN seen AND confidence >= 0.84e0 AND visual_clarity >= 80 AND player_cov >= 0.8e0 AND ball_cov >= 0.3e0 AND joint_vis >= 0.7e0 AND joint_fit_cov >= 0.65e0 AND gap_s <= allow AND stable AND ready AND done THEN 'ai_confirmed_joint_scene'
      WHEN rep AND seen AND confidence >= 0.84e0 AND player_cov >= 0.85e0 AND joint_fit_cov >= 0.62e0 AND gap_s <= allow AND stable AND visual_clarity >= 88 AND ready AND done THEN 'ai_confirmed_close_replay'
      WHEN goal AND NOT done THEN 'incomplete_goal_action' WHEN goal AND NOT ready THEN 'missing_goal_payoff' WHEN ball_cov < 0.3e0 OR gap_s > allow THEN 'ball_not_visibly_continuous' WHEN NOT stable THEN 'unstable_camera' ELSE 'insufficient_joint_framing' END AS mode FROM h)
  SELECT moment_id, mode, mode IN ('planned_reaction', 'full_bleed_repaired', 'phase_verified_goal', 'phase_verified_action', 'strict', 'ai_confirmed_joint_scene', 'ai_confirmed_close_replay') AS usable FROM i""")
def _(v):
    return Q.framing_verdict(v.moments.selectExpr(*WIDE)).select("moment_id", "mode", "usable")


SCN = ["match_id", "scene_id", "CAST(1000 + 100 * (match_id % 5) AS BIGINT) AS contact_ms", "CAST(2400 AS BIGINT) AS payoff_ms", "(match_id % 16) / 16e0 AS goal_x"]


def scenes(v, cols):
    return v.frames.select("match_id", "scene_id").distinct().selectExpr(*cols)


SCN_SQL = f"scn AS (SELECT {', '.join(SCN)} FROM (SELECT DISTINCT match_id, scene_id FROM frames_v))"


@query("goal_side_conflict", f"""WITH {SCN_SQL}, r AS (SELECT f.*, contact_ms, payoff_ms, goal_x, t_ms BETWEEN contact_ms - 320 AND contact_ms + 240 AS nr, t_ms BETWEEN contact_ms + 280 AND payoff_ms + 120 AS fl FROM frames_v f JOIN scn USING (match_id, scene_id) WHERE ball_x IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY match_id, scene_id, fl ORDER BY t_ms DESC) AS bk FROM r),
  g AS (SELECT match_id, scene_id, count(*) FILTER (nr) AS a, count(*) FILTER (fl) AS b, median(ball_x) FILTER (nr) AS cx, median(ball_x) FILTER (fl AND bk <= 5) AS fx, max(goal_x) AS gx FROM k GROUP BY ALL)
  SELECT match_id, scene_id, coalesce(a >= 2 AND b >= 2 AND abs(fx - cx) >= 0.055e0 AND (fx - cx) * (gx - cx) < 0, false) AS conflict FROM g""")
def _(v):
    return Q.goal_side_conflict(v.frames.select("match_id", "scene_id", "t_ms", "ball_x"), scenes(v, SCN))


@query("scorer_track", f"""WITH {SCN_SQL}, r AS (SELECT f.*, contact_ms FROM frames_v f JOIN scn USING (match_id, scene_id) WHERE direct),
  d AS (SELECT r.match_id, r.scene_id, r.t_ms, contact_ms, p.track_id AS pid, p.track_age, CASE WHEN ball_x BETWEEN p.x1 - 0.012e0 AND p.x2 + 0.012e0 AND ball_y BETWEEN p.y1 - 0.025e0 AND p.y1 + (p.y2 - p.y1) * 0.18e0
      THEN least(sqrt(pow(p.cx - ball_x, 2) + pow((p.y2 - ball_y) * 0.52e0, 2)), sqrt(pow(p.cx - ball_x, 2) + pow((p.y1 + (p.y2 - p.y1) * 0.08e0 - ball_y) * 0.52e0, 2))) ELSE sqrt(pow(p.cx - ball_x, 2) + pow((p.y2 - ball_y) * 0.52e0, 2)) END AS d
    FROM r JOIN players_v p USING (match_id, scene_id, frame) WHERE r.t_ms BETWEEN contact_ms - 450 AND contact_ms + 160 AND role <> 'referee' AND p.pitch_support >= 0.08e0 AND p.confidence >= 0.35e0),
  b AS (SELECT match_id, scene_id, arg_min(pid, struct_pack(s := d * 4.5e0 + abs(t_ms - contact_ms) / 1000 * 0.72e0 + CASE WHEN t_ms > contact_ms + 40 THEN 0.025e0 ELSE 0 END - least(12, track_age) * 0.002e0, l := abs(t_ms - contact_ms), d := d, p := pid)) AS pid FROM d WHERE d <= 0.11e0 GROUP BY ALL),
  e AS (SELECT match_id, scene_id, arg_min(track_id, struct_pack(o := CASE WHEN possession THEN 0 ELSE 1 END, a := abs(t_ms - contact_ms), b := t_ms > contact_ms, c := -subject_confidence, d := track_id)) AS tid FROM r WHERE t_ms BETWEEN contact_ms - 450 AND contact_ms + 120 AND joint_fit AND track_id IS NOT NULL AND subject_confidence >= 0.48e0 GROUP BY ALL)
  SELECT match_id, scene_id, coalesce(pid, tid) AS scorer_id FROM scn LEFT JOIN b USING (match_id, scene_id) LEFT JOIN e USING (match_id, scene_id)""")
def _(v):
    return Q.scorer_track(v.players, v.frames.select("match_id", "scene_id", "frame", "t_ms", "ball_x", "ball_y", "direct", "joint_fit", "track_id", "subject_confidence", "possession"), scenes(v, SCN))


STR = ["match_id", "scene_id", "t_ms", "true AS direct", "k % 9 <> 1 AS joint_fit", "CASE WHEN k % 6 = 0 THEN 2 ELSE scene_id % 4 END AS track_id", "0.6e0 + subject_confidence / 2 AS subject_confidence"]


@query("stable_track", f"""WITH s AS (SELECT {', '.join(STR)} FROM frames_v WHERE t_ms BETWEEN 400 AND 1900), n AS (SELECT match_id, scene_id, count(*) AS n FROM s GROUP BY ALL),
  p AS (SELECT match_id, scene_id, track_id, count(*) AS hits, avg(subject_confidence) AS m FROM s WHERE joint_fit AND subject_confidence >= 0.58e0 GROUP BY ALL), t AS (SELECT *, sum(hits) OVER (PARTITION BY match_id, scene_id) AS tot FROM p)
  SELECT match_id, scene_id, track_id FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY match_id, scene_id ORDER BY hits DESC, m DESC, track_id DESC) = 1) JOIN n USING (match_id, scene_id) WHERE n >= 5 AND tot >= 5 AND hits / n >= 0.7e0 AND m >= 0.65e0""")
def _(v):
    return Q.stable_track(v.frames.selectExpr(*STR), 400, 1900)


BX = ["match_id", "scene_id", "CASE WHEN match_id % 2 = 0 THEN (match_id % 10) / 16e0 + 0.2e0 END AS goal_focus_x", "(match_id % 10) / 16e0 AS g1", "0.3e0 AS g2", "(match_id % 10) / 16e0 + 0.3e0 AS g3", "0.8e0 AS g4"]


@query("outcome_subject", f"""WITH bx AS (SELECT {', '.join(BX)} FROM (SELECT DISTINCT match_id, scene_id FROM frames_v)), j AS (SELECT p.*, ball_x AS bbx, ball_y AS bby, g1, g2, g3, g4, coalesce(goal_focus_x, (g1 + g3) / 2) AS gx, (g2 + g4) / 2 AS gy FROM players_v p JOIN (SELECT match_id, scene_id, frame, ball_x, ball_y FROM frames_v WHERE direct) USING (match_id, scene_id, frame) JOIN bx USING (match_id, scene_id)),
  s AS (SELECT *, round(abs(cx - gx) * 1.55e0 + abs(cy - gy) * 0.24e0 + sqrt(pow(cx - bbx, 2) + pow((cy - bby) * 0.45e0, 2)) * 0.22e0 - least(0.05e0, greatest(0, track_age - 1) * 0.006e0) - confidence * 0.03e0, 9) AS sc FROM j
    WHERE pitch_support >= 0.04e0 AND y2 - y1 >= 0.032e0 AND abs(cx - gx) <= greatest(0.18e0, (g3 - g1) * 0.75e0) AND cx BETWEEN g1 - 0.16e0 AND g3 + 0.16e0 AND cy BETWEEN g2 - 0.18e0 AND least(1e0, g4 + 0.16e0) AND sqrt(pow(cx - bbx, 2) + pow((y2 - bby) * 0.52e0, 2)) <= 0.14e0)
  SELECT match_id, scene_id, frame, arg_min(idx, struct_pack(s := sc, i := idx)) AS idx FROM s GROUP BY ALL""")
def _(v):
    balls = v.frames.where("direct").select("match_id", "scene_id", "frame", F.col("ball_x").alias("bx"), F.col("ball_y").alias("by"))
    return Q.outcome_subject(v.players, balls, scenes(v, BX))


@query("section_summary", f"""WITH {PLAN_SQL} SELECT p.match_id, section, any_value(requested_ms) AS requested_ms, count(moment_id) AS scenes, CAST(coalesce(sum(m.end_ms - m.start_ms), 0) AS BIGINT) AS selected_ms FROM plan p
  LEFT JOIN moments_v m ON m.match_id = p.match_id AND (m.start_ms + m.end_ms) / 2 >= p.start_ms AND (m.start_ms + m.end_ms) / 2 < p.core_end_ms GROUP BY p.match_id, section""")
def _(v):
    return Q.section_summary(v.moments, W.section_plan(src(v)))


SB = ["match_id", "ordinal", "CASE WHEN ordinal % 11 = 3 THEN '' WHEN ordinal % 11 <> 5 THEN concat('b', CAST(ordinal % 40 AS STRING)) END AS beat_id", "moment_id", "CASE WHEN ordinal % 13 <> 4 THEN ordinal * 10 - (ordinal % 5) * 900 END AS visual_ms", "CASE WHEN ordinal % 4 = 0 THEN NULL ELSE description END AS narration", "CASE WHEN ordinal % 6 <> 1 THEN 2000 + ordinal % 900 END AS speech_ms", "2300 + ordinal % 700 AS length_ms"]


@query("sync_problems", f"""WITH b0 AS (SELECT {', '.join(SB)} FROM moments_v), b AS (SELECT * REPLACE (coalesce(nullif(beat_id, ''), moment_id) AS beat_id) FROM b0), r AS (SELECT *, last_value(visual_ms IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM b), f AS (SELECT match_id, beat_id, min(ordinal) AS fo FROM b WHERE narration IS NOT NULL GROUP BY ALL),
  c AS (SELECT r.match_id, ordinal, r.beat_id, CASE WHEN visual_ms IS NULL OR visual_ms + 1 < pv THEN 'non_monotonic_visual' END AS p1, CASE WHEN narration IS NOT NULL AND speech_ms IS NULL THEN 'missing_speech' END AS p2, CASE WHEN narration IS NOT NULL AND length_ms + 30 < speech_ms THEN 'speech_exceeds_visual' END AS p3,
    CASE WHEN narration IS NOT NULL AND ordinal > fo THEN 'duplicate_narrated_beat' END AS p4 FROM r LEFT JOIN f ON f.match_id = r.match_id AND f.beat_id = r.beat_id)
  SELECT match_id, ordinal, beat_id, p AS problem FROM (SELECT match_id, ordinal, beat_id, unnest([p1, p2, p3, p4]) AS p FROM c) WHERE p IS NOT NULL""")
def _(v):
    return Q.sync_problems(v.moments.selectExpr(*SB), F.floor(F.col("ordinal") / 2048))


OB = ["match_id", "concat('b', CAST(ordinal AS STRING)) AS beat_id", "ordinal", "moment_id AS evidence_id"]


@query("order_problems", f"""WITH b AS (SELECT {', '.join(OB)}, (start_ms // 60000) AS position FROM moments_v WHERE ordinal % 3 <> 0), r AS (SELECT *, lag(position) OVER (PARTITION BY match_id ORDER BY ordinal) AS pv FROM b) SELECT match_id, beat_id FROM r WHERE position <= pv""")
def _(v):
    man = v.moments.where("ordinal % 3 <> 0").selectExpr("match_id", "moment_id", "start_ms div 60000 AS position")
    return Q.order_problems(v.moments.selectExpr(*OB), man, F.floor(F.col("ordinal") / 2048))


@query("story_deficiencies", f"""WITH ok AS (SELECT * FROM moments_v WHERE keep_decision <> 'reject'), g AS (SELECT * FROM ok WHERE event_type = 'goal' AND {LIVE}), p AS (SELECT g.match_id, g.moment_id,
    CASE WHEN NOT EXISTS (SELECT 1 FROM ok r WHERE r.match_id = g.match_id AND r.story_id = g.story_id AND r.moment_id <> g.moment_id AND (r.is_replay OR r.story_phase = 'replay')) THEN 'missing_same_goal_replay' END AS a,
    CASE WHEN NOT EXISTS (SELECT 1 FROM ok r WHERE r.match_id = g.match_id AND r.story_id = g.story_id AND r.moment_id <> g.moment_id AND (r.event_type = 'celebration' OR r.story_phase = 'reaction')) THEN 'missing_immediate_goal_celebration' END AS b FROM g)
  SELECT match_id, moment_id, x AS problem FROM (SELECT match_id, moment_id, unnest([a, b]) AS x FROM p) WHERE x IS NOT NULL""")
def _(v):
    return Q.story_deficiencies(v.moments)


@query("sequence_problems", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY coalesce(edit_order, 1000000), ordinal) AS n, {REACT} AS re, is_replay OR story_phase = 'replay' AS rp FROM (SELECT * REPLACE ('s' || start_ms // 1200000 AS story_id) FROM moments_v) WHERE selected),
  g AS (SELECT * FROM n WHERE event_type = 'goal' AND NOT rp), p AS (SELECT g.match_id, g.moment_id, CASE WHEN NOT EXISTS (SELECT 1 FROM n f WHERE f.match_id = g.match_id AND f.n = g.n + 1 AND f.story_id = g.story_id AND (f.re OR f.rp)) THEN 'goal_cut_to_unrelated_scene' END AS a,
    CASE WHEN NOT EXISTS (SELECT 1 FROM n f WHERE f.match_id = g.match_id AND f.n BETWEEN g.n + 1 AND g.n + 3 AND f.story_id = g.story_id AND f.re) THEN 'goal_missing_celebration' END AS b FROM g)
  SELECT match_id, moment_id, x AS problem FROM (SELECT match_id, moment_id, unnest([a, b]) AS x FROM p) WHERE x IS NOT NULL""")
def _(v):
    rows = v.moments.withColumns(dict(story_id=F.expr("concat('s', CAST(start_ms div 1200000 AS STRING))"), edit_order=F.expr("coalesce(edit_order, 1000000)")))
    return Q.sequence_problems(rows, F.floor(F.col("key") / 4))


WJ = ["match_id", "CASE match_id % 9 WHEN 0 THEN 'completed' WHEN 1 THEN 'tracking' WHEN 2 THEN 'failed' WHEN 3 THEN 'waiting_retry' WHEN 4 THEN 'writing_content' WHEN 5 THEN 'ranking' WHEN 6 THEN 'rendering' WHEN 7 THEN 'generating_commentary' ELSE CASE WHEN match_id % 2 = 0 THEN 'editing' ELSE 'analyzing' END END AS stage",
      "CASE WHEN match_id % 2 = 0 THEN 'voice' END AS workflow_phase", "CASE WHEN match_id % 4 = 1 THEN 1 END AS production_version", "CASE match_id % 5 WHEN 1 THEN true WHEN 2 THEN false END AS narration_recorded", "match_id % 11 = 4 AS capacity_wait", "match_id % 3 = 1 AS visual_ready", "match_id % 3 = 2 AS visual_locked",
      "match_id % 7 > 3 AS script_approved", "match_id % 7 = 6 AS render_completed", "CASE WHEN match_id % 6 = 5 THEN false END AS voice"]
WS = ["match_id", "moment_id", "CASE ordinal % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_repair' ELSE 'pending' END AS saved_status", "ordinal % 50 <> 7 OR match_id % 4 = 1 AS prepared"]


WP_SQL = f"""j AS (SELECT {', '.join(WJ)} FROM sources_v), s AS (SELECT {', '.join(WS)} FROM moments_v WHERE ordinal % 5 <> 4 OR match_id % 4 = 1), l AS (SELECT m.*, saved_status, prepared, tracking_passed IS TRUE OR coalesce(saved_status = 'verified', false) AS ok FROM moments_v m LEFT JOIN s USING (match_id, moment_id) WHERE selection_locked),
  p AS (SELECT match_id, count(*) AS selected, count(*) FILTER (ok) AS verified, count(*) FILTER (NOT ok AND saved_status = 'needs_repair') AS needs_repair, count(*) FILTER (prepared) AS prep, CAST(sum(end_ms - start_ms) AS BIGINT) AS selected_ms FROM l GROUP BY match_id),
  wp AS (SELECT match_id, CASE WHEN stage IN ('failed', 'waiting_retry') THEN coalesce(workflow_phase, 'split') WHEN stage = 'completed' THEN 'review' WHEN stage = 'editing' AND production_version = 1 AND narration_recorded IS FALSE THEN 'effects' WHEN stage IN ('rendering', 'editing') THEN 'render' WHEN stage = 'generating_commentary' THEN 'voice' WHEN stage = 'writing_content' THEN 'script' WHEN stage = 'ranking' THEN 'effects'
     WHEN stage = 'tracking' AND selected > 0 AND prep = selected THEN 'tracking' ELSE 'split' END AS phase, coalesce(selected, 0) AS selected, coalesce(verified, 0) AS verified, coalesce(needs_repair, 0) AS needs_repair, coalesce(selected_ms, 0) AS selected_ms,
   stage = 'completed' OR coalesce(selected > 0 AND prep = selected, false) AS split_done, stage = 'completed' OR coalesce(selected > 0 AND verified = selected, false) AS tracking_done, stage = 'waiting_retry' OR capacity_wait AS waiting FROM j LEFT JOIN p USING (match_id))"""


def saved_states(v):
    return v.moments.where("ordinal % 5 <> 4 OR match_id % 4 = 1").selectExpr(*WS)


@query("workflow_progress", f"WITH {WP_SQL} SELECT * FROM wp")
def _(v):
    return Q.workflow_progress(v.sources.selectExpr(*WJ), v.moments, saved_states(v))


@query("step_status", f"""WITH {WP_SQL}, w AS (SELECT wp.*, j.* EXCLUDE (match_id) FROM wp JOIN j USING (match_id)), sx AS (SELECT match_id, phase, stage, waiting, voice, unnest({Q.STEPS!r}) AS step, unnest(range(1, 8)) AS number, unnest([split_done, tracking_done,
    CASE WHEN production_version = 1 THEN visual_ready ELSE visual_locked END, script_approved, narration_recorded IS TRUE, render_completed, false]) AS done FROM w)
  SELECT match_id, step, CAST(number AS INTEGER) AS number, CASE WHEN step = 'voice' AND voice IS FALSE THEN 'skipped' WHEN stage = 'completed' OR done THEN 'complete' WHEN phase = step THEN CASE WHEN stage = 'failed' THEN 'paused' WHEN waiting THEN 'waiting' ELSE 'active' END ELSE 'pending' END AS status FROM sx""")
def _(v):
    jobs = v.sources.selectExpr(*WJ)
    return Q.step_status(Q.workflow_progress(jobs, v.moments, saved_states(v)), jobs)


WA = ["concat('m', CAST(match_id * 3 AS STRING)) AS active_id", "CASE match_id % 3 WHEN 0 THEN 'repairing' WHEN 1 THEN 'tracking' ELSE 'idle' END AS active_status", "match_id % 4 AS active_round"]


@query("scene_progress", f"""WITH j AS (SELECT {', '.join(WJ)}, 'm' || first AS active_id, {', '.join(WA[1:])} FROM (SELECT match_id, min(ordinal) AS first FROM moments_v WHERE selection_locked AND tracking_passed IS NOT TRUE GROUP BY match_id) RIGHT JOIN sources_v USING (match_id)),
  s AS (SELECT {', '.join(WS)}, ordinal % 6 AS saved_round FROM moments_v WHERE ordinal % 5 <> 4 OR match_id % 4 = 1), l AS (SELECT m.*, row_number() OVER (PARTITION BY match_id ORDER BY start_ms, ordinal) AS place FROM moments_v m WHERE selection_locked),
  b AS (SELECT l.*, s.saved_status, s.saved_round, s.prepared, j.stage, j.active_status, j.active_round, tracking_passed IS TRUE OR coalesce(saved_status = 'verified', false) AS done, coalesce(j.active_id = l.moment_id, false) AS mine FROM l LEFT JOIN s ON s.match_id = l.match_id AND s.moment_id = l.moment_id JOIN j ON j.match_id = l.match_id)
  SELECT match_id, moment_id, place, CASE WHEN done THEN 'verified' WHEN mine AND stage = 'failed' THEN 'needs_repair' WHEN mine AND active_status <> 'idle' THEN active_status WHEN saved_status = 'needs_repair' THEN 'needs_repair' ELSE 'pending' END AS status,
    CAST(CASE WHEN mine AND NOT done THEN CASE WHEN active_round = 0 THEN 1 ELSE active_round END ELSE coalesce(saved_round, 0) END AS BIGINT) AS round, coalesce(prepared, false) AS source_prepared FROM b""")
def _(v):
    first = v.moments.where("selection_locked AND tracking_passed IS NOT TRUE").groupBy("match_id").agg(F.min("ordinal").alias("first"))
    jobs = v.sources.selectExpr(*WJ, *WA[1:]).join(first, "match_id", "left").withColumn("active_id", F.concat(F.lit("m"), F.col("first").cast("string")))
    return Q.scene_progress(jobs, v.moments, v.moments.where("ordinal % 5 <> 4 OR match_id % 4 = 1").selectExpr(*WS, "ordinal % 6 AS saved_round"))


SEC = ["match_id", "i AS section", "CAST(i * 180000 AS BIGINT) AS start_ms", "CAST((i + 1) * 180000 AS BIGINT) AS end_ms", "CAST(7 AS BIGINT) AS scene_count", "CAST(700 AS BIGINT) AS selected_ms"]
LOCKS = "CASE WHEN match_id % 3 = 0 THEN selection_locked END"
CHECKED = "CASE WHEN match_id % 6 <> 5 THEN semantic_verified END"


@query("section_progress", f"""WITH m AS (SELECT * REPLACE ({LOCKS} AS selection_locked, {CHECKED} AS semantic_verified) FROM moments_v), x AS (SELECT {', '.join(SEC)} FROM sources_v, (SELECT unnest(range(31)) AS i)),
  v AS (SELECT *, selection_locked IS TRUE AS lk, semantic_verified IS TRUE AND action_complete IS TRUE AND keep_decision <> 'reject' AND NOT angle_deferred AND NOT support_deferred AS ok FROM m), a AS (SELECT match_id, bool_or(lk) AS al, bool_or(ok) AS ao FROM v GROUP BY match_id),
  u AS (SELECT v.* FROM v JOIN a USING (match_id) WHERE CASE WHEN al THEN lk ELSE ok END)
  SELECT x.match_id, section, CASE WHEN al OR ao THEN count(u.moment_id) ELSE any_value(x.scene_count) END AS scene_count, CAST(CASE WHEN al OR ao THEN coalesce(sum(u.end_ms - u.start_ms), 0) ELSE any_value(x.selected_ms) END AS BIGINT) AS selected_ms
  FROM x JOIN a USING (match_id) LEFT JOIN u ON u.match_id = x.match_id AND floor((u.start_ms + u.end_ms) / 2) >= x.start_ms AND floor((u.start_ms + u.end_ms) / 2) < x.end_ms GROUP BY x.match_id, section, al, ao""")
def _(v):
    m = v.moments.withColumns(dict(selection_locked=F.expr(LOCKS), semantic_verified=F.expr(CHECKED)))
    return Q.section_progress(v.sources.selectExpr("match_id", "explode(sequence(0L, 30L)) AS i").selectExpr(*SEC), m)


RVW = ["match_id", "moment_id", "ordinal", "event_type", "story_phase", "start_ms", "end_ms", "selection_locked", "ordinal % 11 <> 1 AS passed", "ordinal % 13 <> 2 AS correct_subject", "ordinal % 17 <> 3 AS stable_camera", "ordinal % 19 <> 4 AS ball_followed", "ordinal % 23 <> 5 AS setup_visible", "ordinal % 29 <> 6 AS contact_visible",
       "ordinal % 31 <> 7 AS outcome_visible", "CASE ordinal % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ball_entered", "ordinal % 2 = 0 AS goal_visible", "ordinal % 5 <> 0 AS paired_goal", "1000 + (ordinal % 9) * 100 AS paired_ms", "CASE WHEN ordinal % 37 = 0 THEN 1 ELSE 0 END AS issue_count",
       "CASE WHEN ordinal % 8 = 7 THEN 400000 ELSE 1400 END AS outcome_ms", "CASE WHEN ordinal % 10 = 9 THEN 'short' ELSE 'the keeper reaches it' END AS outcome_text",
       "CASE ordinal % 9 WHEN 0 THEN 'goal' WHEN 1 THEN 'keeper_save' WHEN 2 THEN 'woodwork' WHEN 3 THEN 'blocked' WHEN 4 THEN 'wide' WHEN 5 THEN 'over' WHEN 6 THEN 'goal' WHEN 7 THEN 'uncertain' END AS outcome_type", "ordinal % 4 <> 2 AS keeper_contact", "ordinal % 3 AS observation_count",
       "CASE ordinal % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'shot_off_target' WHEN 2 THEN 'big_chance' ELSE 'other' END AS source_type", "CASE WHEN ordinal % 7 = 0 THEN NULL ELSE ordinal % 7 = 1 END AS source_scored"]
RVW_SQL = f"""rv0 AS (SELECT {', '.join(RVW)} FROM moments_v),
 rv AS (SELECT *, CASE WHEN passed AND correct_subject AND stable_camera AND ball_followed AND setup_visible AND contact_visible AND outcome_visible AND issue_count = 0 AND outcome_ms BETWEEN 0 AND end_ms - start_ms AND length(trim(outcome_text)) >= 12 THEN
   CASE WHEN event_type IN ('goal', 'disallowed_goal') THEN CASE WHEN outcome_type = 'goal' AND ball_entered IS TRUE THEN event_type WHEN selection_locked IS TRUE THEN CASE outcome_type WHEN 'woodwork' THEN 'big_chance' WHEN 'blocked' THEN 'big_chance' WHEN 'wide' THEN 'shot_off_target' WHEN 'over' THEN 'shot_off_target' END END
        WHEN event_type IN ('save', 'shot_on_target', 'shot_off_target', 'big_chance') THEN CASE WHEN outcome_type = 'goal' AND ball_entered IS TRUE AND goal_visible AND paired_goal AND abs(outcome_ms - paired_ms) <= 500 THEN 'goal'
          WHEN ball_entered IS FALSE THEN CASE outcome_type WHEN 'keeper_save' THEN 'save' WHEN 'woodwork' THEN 'big_chance' WHEN 'blocked' THEN 'big_chance' WHEN 'wide' THEN 'shot_off_target' WHEN 'over' THEN 'shot_off_target' END END END END AS reviewed_event FROM rv0)"""


@query("reviewed_event", f"WITH {RVW_SQL} SELECT moment_id, reviewed_event FROM rv")
def _(v):
    return Q.reviewed_event(v.moments.selectExpr(*RVW)).select("moment_id", "reviewed_event")


@query("effective_checks", f"""WITH {RVW_SQL} SELECT moment_id, array_to_string(list_sort([x FOR x IN ['keeperContactVisible', 'reboundFollowed', 'receiverVisible'] IF NOT (x = 'keeperContactVisible' AND reviewed_event IS NOT NULL AND outcome_type IN ('goal', 'woodwork', 'blocked', 'wide', 'over'))
   AND NOT (x = 'reboundFollowed' AND coalesce((reviewed_event = 'goal' AND ball_entered IS TRUE) OR reviewed_event IN ('shot_off_target', 'big_chance'), false))]), ',') AS checks FROM rv""")
def _(v):
    rows = v.moments.selectExpr(*RVW).withColumn("required", F.array(F.lit("keeperContactVisible"), F.lit("reboundFollowed"), F.lit("receiverVisible")))
    return Q.effective_checks(rows).select("moment_id", "checks")


@query("review_verdict", f"""WITH {RVW_SQL}, a AS (SELECT *, {REACT} AS sup, event_type IN ('goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance') AS shot, event_type IN ('save', 'shot_on_target', 'shot_off_target', 'big_chance') AS non FROM rv),
  m AS (SELECT *, list_sort([x FOR x IN [CASE WHEN NOT passed THEN 'passed' END, CASE WHEN NOT correct_subject THEN 'correct_subject' END, CASE WHEN NOT stable_camera THEN 'stable_camera' END, CASE WHEN NOT outcome_visible THEN 'outcome_visible' END, CASE WHEN NOT sup AND NOT ball_followed THEN 'ball_followed' END,
     CASE WHEN NOT sup AND NOT setup_visible THEN 'setup_visible' END, CASE WHEN NOT sup AND NOT contact_visible THEN 'contact_visible' END, CASE WHEN event_type = 'goal' AND ball_entered IS NOT TRUE THEN 'ball_entered' END, CASE WHEN non AND (ball_entered IS TRUE OR outcome_type = 'goal') THEN 'crop_outcome_contradicts_selected_non_goal' END,
     CASE WHEN shot AND outcome_type IS NOT NULL AND NOT (outcome_ms BETWEEN 0 AND end_ms - start_ms AND length(outcome_text) >= 12 AND outcome_type <> 'uncertain') THEN 'unobserved_finishing_outcome' END, CASE WHEN event_type = 'goal' AND outcome_type <> 'goal' THEN 'crop_outcome_contradicts_selected_goal' END,
     CASE WHEN shot AND outcome_type = 'keeper_save' AND NOT keeper_contact THEN 'keeper_touch_unobserved' END, CASE WHEN ordinal % 6 = 0 THEN 'unobserved_flight_gap' END] IF x IS NOT NULL]) AS q FROM a)
  SELECT moment_id, array_to_string(q, ',') AS missing, len(q) = 0 AND observation_count >= 2 AS usable FROM m""")
def _(v):
    rows = v.moments.selectExpr(*RVW, "array('contact', 'flight') AS gaps", "CASE WHEN ordinal % 6 = 0 THEN array('contact') ELSE array('contact', 'flight', 'payoff') END AS phase_seen")
    return Q.review_verdict(rows).select("moment_id", "missing", "usable")


GATE = ["ordinal % 41 <> 3 AS versions_current", "ordinal % 43 <> 5 AS geometry_verified", "CASE WHEN ordinal % 47 <> 6 THEN true END AS semantic_verified", "CASE ordinal % 37 WHEN 8 THEN false WHEN 9 THEN NULL ELSE true END AS action_complete", "ordinal % 3 <> 1 AS subject_core"]
ASKED = ["keeperContactVisible", "reboundFollowed", "receiverVisible"]


@query("crop_gate", f"""WITH {RVW_SQL}, g AS (SELECT rv.*, {', '.join(GATE)}, {REACT} OR event_type IN ('var', 'offside', 'disallowed_goal') AS sup, [x FOR x IN {ASKED!r} IF NOT (x = 'keeperContactVisible' AND reviewed_event IS NOT NULL AND coalesce(outcome_type, '') IN ('goal', 'woodwork', 'blocked', 'wide', 'over'))
    AND NOT (x = 'reboundFollowed' AND coalesce((reviewed_event = 'goal' AND ball_entered IS TRUE) OR reviewed_event IN ('shot_off_target', 'big_chance'), false))] AS need FROM rv),
  u AS (SELECT moment_id, ordinal % 53 <> 7 AND versions_current AND geometry_verified AND semantic_verified IS TRUE AND passed AND correct_subject AND stable_camera AND action_complete IS NOT FALSE AND (NOT sup OR subject_core) AND (sup OR (ball_followed AND setup_visible AND contact_visible AND outcome_visible))
    AND (NOT (event_type IN ('goal', 'disallowed_goal') AND (reviewed_event IS NULL OR reviewed_event = event_type)) OR (goal_visible AND ball_entered IS TRUE)) AND (NOT event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance') OR outcome_type IS NULL OR reviewed_event IS NOT NULL)
    AND (coalesce(reviewed_event, '') <> 'save' OR keeper_contact) AND issue_count = 0 AND (ordinal % 4 <> 0 OR NOT list_contains(need, 'keeperContactVisible')) AS usable FROM g)
  SELECT moment_id, usable, CASE WHEN usable THEN 'gemini_crop_verified' ELSE 'gemini_crop_review_incomplete' END AS mode FROM u""")
def _(v):
    asked = F.array(*map(F.lit, ASKED))
    rows = v.moments.selectExpr(*RVW, *GATE).withColumns(dict(
        required=F.when(F.col("ordinal") % 53 != 7, asked), granted=F.when(F.col("ordinal") % 4 == 0, F.array_remove(asked, "keeperContactVisible")).otherwise(asked)))
    return Q.crop_gate(rows).select("moment_id", "usable", "mode")


CHK = [("setup", 100, "ordinal % 5 <> 0"), ("contact", 700, "true"), ("contact", 1500, "ordinal % 3 = 0"), ("flight", 900, "ordinal % 4 <> 1"), ("flight", 1700, "true"), ("payoff", 1900, "ordinal % 2 = 0"), ("payoff", 1200, "ordinal % 7 = 0"), ("contact", 1950, "true")]
CHK_SQL = "chk AS (" + " UNION ALL ".join(f"SELECT match_id, moment_id, '{p}' AS phase, {t} AS c_ms, {b} AS ball_seen, ordinal % 6 <> {i % 6} AS player_seen, CASE WHEN ordinal % 11 = {i} THEN 'short' ELSE 'ball is struck cleanly' END AS text FROM moments_v" for i, (p, t, b) in enumerate(CHK)) + ")"


@query("reviewed_brief", f"""WITH {CHK_SQL}, ok AS (SELECT c.*, start_ms FROM chk c JOIN moments_v m USING (match_id, moment_id) WHERE ball_seen AND length(text) >= 12 AND c_ms <= end_ms - start_ms),
  a AS (SELECT match_id, moment_id, start_ms, min(c_ms) FILTER (phase = 'setup' AND player_seen) AS s, min(c_ms) FILTER (phase = 'payoff') AS p FROM ok GROUP BY ALL),
  b AS (SELECT a.*, max(c_ms) AS c FROM a JOIN ok USING (match_id, moment_id) WHERE phase = 'contact' AND player_seen AND c_ms < p GROUP BY ALL), d AS (SELECT b.*, min(c_ms) AS f FROM b JOIN ok USING (match_id, moment_id) WHERE phase = 'flight' AND c_ms >= c AND c_ms < p GROUP BY ALL)
  SELECT match_id, moment_id, start_ms + s AS origin_ms, start_ms + c AS contact_ms, start_ms + f AS handoff_ms, start_ms + p AS payoff_ms FROM d WHERE s <= c""")
def _(v):
    rows = ", ".join(f"named_struct('phase', '{p}', 'c_ms', {t}, 'ball_seen', {b}, 'player_seen', ordinal % 6 <> {i % 6}, 'text', CASE WHEN ordinal % 11 = {i} THEN 'short' ELSE 'ball is struck cleanly' END)" for i, (p, t, b) in enumerate(CHK))
    checks = v.moments.selectExpr("match_id", "moment_id", f"inline(array({rows}))")
    return Q.reviewed_brief(checks, v.moments.selectExpr("match_id", "moment_id", "start_ms", "end_ms - start_ms AS length_ms"))


@query("merge_finish_review", """WITH a AS (SELECT *, ordinal % 11 <> 1 AS p, ordinal % 13 <> 2 AS c, ordinal % 17 <> 3 AS s, ordinal % 19 <> 4 AS b, ordinal % 23 <> 5 AS su, ordinal % 29 <> 6 AS ct FROM moments_v),
  q AS (SELECT *, ordinal % 7 <> 0 AS c2, ordinal % 5 <> 0 AS s2, list_sort(list_distinct(list_concat(CASE WHEN ordinal % 3 = 0 THEN ['late'] ELSE [] END, CASE WHEN ordinal % 4 = 0 THEN ['late', 'blur'] ELSE [] END))) AS i FROM a)
  SELECT moment_id, c AND c2 AS correct_subject, s AND s2 AS stable_camera, b AS ball_followed, ct AS contact_visible, array_to_string(i, ',') AS issues, p AND su AND len(i) = 0 AND c AND c2 AND s AND s2 AND b AND ct AS passed FROM q""")
def _(v):
    cols = ["match_id", "moment_id", "ordinal % 11 <> 1 AS passed", "ordinal % 19 <> 4 AS ball_followed", "ordinal % 23 <> 5 AS setup_visible", "ordinal % 29 <> 6 AS contact_visible"]
    a = v.moments.selectExpr(*cols, "ordinal % 13 <> 2 AS correct_subject", "ordinal % 17 <> 3 AS stable_camera", "CASE WHEN ordinal % 3 = 0 THEN array('late') ELSE CAST(array() AS ARRAY<STRING>) END AS issues")
    b = v.moments.selectExpr(*cols, "ordinal % 7 <> 0 AS correct_subject", "ordinal % 5 <> 0 AS stable_camera", "CASE WHEN ordinal % 4 = 0 THEN array('late', 'blur') ELSE CAST(array() AS ARRAY<STRING>) END AS issues")
    return Q.merge_finish_review(a, b).drop("match_id")


@query("outcome_policy", f"""WITH {RVW_SQL}, k AS (SELECT *, CASE source_type WHEN 'save' THEN 'keeper_save' WHEN 'shot_off_target' THEN 'miss' WHEN 'big_chance' THEN 'chance' END AS s, CASE outcome_type WHEN 'keeper_save' THEN 'keeper_save' WHEN 'wide' THEN 'miss' WHEN 'over' THEN 'miss' WHEN 'woodwork' THEN 'woodwork' WHEN 'blocked' THEN 'blocked' END AS c FROM rv)
  SELECT moment_id, coalesce(source_scored IS FALSE AND passed AND ball_entered IS FALSE AND event_type NOT IN ('goal', 'disallowed_goal') AND s <> c, false) AS disputed FROM k""")
def _(v):
    return Q.outcome_policy(v.moments.selectExpr(*RVW)).select("moment_id", "disputed")


OC = ["*", "CASE ordinal % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'provisional' END AS score_status", "CASE ordinal % 4 WHEN 0 THEN true WHEN 1 THEN false END AS goal_scored", "CASE ordinal % 5 WHEN 0 THEN 'goal' WHEN 1 THEN 'save' WHEN 2 THEN 'uncertain' ELSE 'goal' END AS o_event",
      "CASE ordinal % 7 WHEN 0 THEN 'disallowed' WHEN 1 THEN 'allowed' END AS goal_decision", "ordinal % 2 = 0 AS same_anchor"]


@query("outcome_conflicts", f"""WITH o AS (SELECT {', '.join(OC)} FROM moments_v), c AS (SELECT *, CASE WHEN score_status = 'unchanged' THEN goal_scored IS TRUE AND o_event = 'goal' AND goal_decision IS DISTINCT FROM 'disallowed' WHEN score_status = 'provisional' THEN (same_anchor OR event_type IN ('goal', 'disallowed_goal')) AND (goal_scored IS NOT TRUE OR o_event <> 'goal' OR goal_decision IS NOT DISTINCT FROM 'disallowed') ELSE false END AS sc FROM o)
  SELECT moment_id, sc AS score_conflict, sc OR (semantic_verified IS TRUE AND proof_verified AND event_type IN ('goal', 'disallowed_goal') AND (goal_scored IS FALSE OR o_event = 'uncertain')) AS conflict FROM c""")
def _(v):
    return Q.outcome_conflicts(v.moments.selectExpr(*OC)).select("moment_id", "score_conflict", "conflict")


RO = ["*", "CASE WHEN ordinal % 6 = 0 THEN 'old' ELSE 'sig' END AS saved_signature", "'sig' AS signature", "start_ms AS saved_start_ms", "CASE WHEN ordinal % 7 = 0 THEN end_ms - 1 ELSE end_ms END AS saved_end_ms", "ordinal % 5 % 2 AS doubts", "ordinal % 4 AS fact_count",
      "CASE WHEN event_type IN ('goal', 'disallowed_goal') THEN true ELSE ordinal % 9 = 0 END AS goal_scored", "CASE WHEN event_type = 'disallowed_goal' THEN 'goal' ELSE event_type END AS o_event", "CASE WHEN event_type IN ('goal', 'disallowed_goal') THEN 'allowed' ELSE 'not_applicable' END AS goal_decision"]


@query("reusable_outcomes", f"""WITH o AS (SELECT {', '.join(RO)} FROM moments_v) SELECT moment_id FROM o WHERE ordinal % 6 <> 0 AND ordinal % 7 <> 0 AND semantic_verified AND action_complete AND proof_verified AND doubts = 0 AND fact_count > 0
   AND CASE WHEN goal_scored THEN o_event = 'goal' ELSE o_event IN ('save', 'shot_on_target', 'shot_off_target', 'big_chance') END AND goal_scored = (event_type IN ('goal', 'disallowed_goal')) AND origin_ms BETWEEN start_ms AND end_ms AND contact_ms BETWEEN start_ms AND end_ms AND payoff_end_ms BETWEEN start_ms AND end_ms AND payoff_start_ms BETWEEN start_ms AND end_ms
   AND contact_ms >= origin_ms AND payoff_start_ms >= contact_ms - 125 AND payoff_end_ms > contact_ms + 50""")
def _(v):
    return Q.reusable_outcomes(v.moments.selectExpr(*RO)).select("moment_id")


@query("outcome_correction", f"""WITH {GUIDE_SQL}, c0 AS (SELECT match_id, moment_id, min(t) AS c FROM ga WHERE phase = 'contact' AND ball AND player GROUP BY ALL), pf AS (SELECT DISTINCT ga.match_id, ga.moment_id FROM ga JOIN c0 USING (match_id, moment_id) WHERE phase = 'payoff' AND ball AND t > c)
  SELECT moment_id, CASE outcome WHEN 'save' THEN 'save' WHEN 'wide' THEN 'shot_off_target' WHEN 'over' THEN 'shot_off_target' ELSE 'big_chance' END AS corrected_type FROM gm JOIN pf USING (match_id, moment_id)
  WHERE event_type IN ('goal', 'disallowed_goal') AND authoritative AND doubts = 0 AND outcome IN ('save', 'wide', 'over', 'blocked', 'woodwork') AND ordinal % 9 <> 4""")
def _(v):
    rows = guided(v).withColumns(dict(guide_outcome=F.col("outcome"), same_source=F.expr("ordinal % 9 <> 4")))
    return Q.outcome_correction(rows).select("moment_id", "corrected_type")


OBS = ["match_id", "scene_id", "t_ms", "ball_x - 0.01e0 AS bx1", "ball_x + 0.01e0 AS bx2", "ball_y - 0.01e0 AS by1", "ball_y + 0.01e0 AS by2", "px - 0.05e0 AS kx1", "px + 0.05e0 AS kx2", "ptop AS ky1", "pbottom AS ky2", "k = 33 AS keeper_touch"]
ORV = ["match_id", "scene_id", "1500 AS outcome_ms", "CASE (match_id + scene_id) % 4 WHEN 0 THEN 'keeper_save' WHEN 1 THEN 'wide' WHEN 2 THEN 'keeper_save' ELSE 'goal' END AS outcome_type"]


@query("outcome_recheck", f"""WITH r AS (SELECT {', '.join(ORV)} FROM (SELECT DISTINCT match_id, scene_id FROM frames_v)), g AS (SELECT r.match_id, r.scene_id, outcome_type, coalesce(bool_or(abs(t_ms - 1500) <= 500 AND bx1 <= kx2 + 0.02e0 AND bx2 >= kx1 - 0.02e0 AND by1 <= ky2 + 0.02e0 AND by2 >= ky1 - 0.02e0), false) AS c, bool_or(keeper_touch) AS k
    FROM r LEFT JOIN (SELECT {', '.join(OBS)} FROM frames_v) o USING (match_id, scene_id) GROUP BY ALL) SELECT match_id, scene_id, outcome_type FROM g WHERE (outcome_type = 'keeper_save' AND NOT c) OR (outcome_type = 'wide' AND k)""")
def _(v):
    return Q.outcome_recheck(scenes(v, ORV), v.frames.selectExpr(*OBS))


PG = ["match_id", "scene_id", "t_ms", "phase", "CASE k % 9 WHEN 0 THEN 'possession' WHEN 1 THEN 'receive' WHEN 2 THEN 'release' WHEN 3 THEN 'result' WHEN 4 THEN 'keeper_touch' WHEN 5 THEN 'rebound' ELSE 'travel' END AS situation", "k % 31 <> 0 AS ball_seen", "track_id IS NOT NULL AS player_seen", "match_id % 6 = 0 AS subject_only"]


@query("plan_gate", f"""WITH o AS (SELECT {', '.join(PG)} FROM frames_v), st AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER w, 100) AS step, count(*) FILTER (ball_seen) OVER w AS run FROM o WINDOW w AS (PARTITION BY match_id, scene_id ORDER BY t_ms)),
  gp AS (SELECT match_id, scene_id, max(g) AS gap FROM (SELECT match_id, scene_id, run, sum(CASE WHEN ball_seen THEN 0 ELSE step END) AS g FROM st GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT match_id, scene_id, bool_or((phase = 'setup' OR situation IN ('possession', 'receive')) AND ball_seen AND player_seen) AS s, bool_or((phase = 'contact' OR situation = 'release') AND ball_seen AND player_seen) AS c, bool_or((phase = 'payoff' OR situation = 'result') AND ball_seen) AS p,
     count(*) FILTER (ball_seen) / count(*) AS cov, bool_or(subject_only) AS sub, bool_or(situation = 'receive') AS rc, bool_or(situation = 'keeper_touch') AS kt, bool_or(situation = 'rebound') AS rb FROM o GROUP BY ALL)
  SELECT match_id, scene_id, sub OR (s AND c AND p AND gap <= 400 AND cov >= 0.9e0) AS usable, array_to_string([x FOR x IN [CASE WHEN NOT sub AND kt THEN 'keeperContactVisible' END, CASE WHEN NOT sub AND rb THEN 'reboundFollowed' END, CASE WHEN NOT sub AND rc THEN 'receiverVisible' END] IF x IS NOT NULL], ',') AS checks FROM g JOIN gp USING (match_id, scene_id)""")
def _(v):
    return Q.plan_gate(v.frames.selectExpr(*PG), F.col("subject_only"))
