"""Queries ranking and choosing moments under budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators import linking as K
from matchspark.operators import quality as Q
from matchspark.operators import selection as SEL
from matchspark.operators import windows as W
from matchspark.operators.timeline import scan
from matchspark.plans.catalog.intervals import PLAN_SQL, src
from matchspark.plans.catalog.moments import PACK_SQL, scored
from matchspark.plans.registry import query

LIVE = "NOT (is_replay OR story_phase = 'replay')"
REACT = "(event_type = 'celebration' OR story_phase = 'reaction')"
PRIO = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.INCIDENT_PRIORITY.items()) + " ELSE 0 END"


def nms_sql(src_sql: str) -> str:
    """Recursive interval suppression over ``src_sql``; ends in relation ``nms``."""
    return f"""sm AS MATERIALIZED ({src_sql}),
  sok AS (SELECT * FROM sm WHERE semantic_verified AND action_complete AND NOT {REACT} AND end_ms > start_ms AND proof_verified AND contact_ms BETWEEN start_ms AND end_ms AND proof_start_ms >= contact_ms AND proof_end_ms >= proof_start_ms AND proof_end_ms <= end_ms),
  same AS MATERIALIZED (SELECT a.match_id, a.moment_id AS a_id, b.moment_id AS b_id FROM sok a JOIN sok b ON a.match_id = b.match_id AND a.ordinal <> b.ordinal AND abs(a.contact_ms - b.contact_ms) <= 350 AND abs(a.proof_start_ms - b.proof_start_ms) <= 500
    AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= least(a.end_ms - a.start_ms, b.end_ms - b.start_ms) * 0.35e0 AND least(a.proof_end_ms, b.proof_end_ms) >= greatest(a.proof_start_ms, b.proof_start_ms)),
  ev AS (SELECT *, {REACT} AS react, CASE WHEN {REACT} THEN least(end_ms, start_ms + 3000) ELSE end_ms END AS cut FROM sm),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN semantic_verified AND action_complete IS NOT FALSE AND keep_decision <> 'reject' THEN 0 ELSE 1 END, CASE WHEN semantic_verified IS FALSE THEN 1 ELSE 0 END,
     importance DESC, end_ms - start_ms DESC, ordinal) AS rn FROM ev),
  cf AS MATERIALIZED (SELECT b.match_id, b.rn, list(a.rn) AS q FROM rk a JOIN rk b ON a.match_id = b.match_id AND a.rn < b.rn AND a.react = b.react
     AND (greatest(0, least(a.cut, b.cut) - greatest(a.start_ms, b.start_ms)) >= least(a.cut - a.start_ms, b.cut - b.start_ms) * 0.8e0
       OR EXISTS (SELECT 1 FROM same s WHERE s.match_id = a.match_id AND s.a_id = a.moment_id AND s.b_id = b.moment_id)) GROUP BY b.match_id, b.rn),
  wk AS (SELECT match_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT match_id FROM rk) UNION ALL
    SELECT w.match_id, w.rn + 1, CASE WHEN list_has_any(coalesce(cf.q, []::BIGINT[]), w.kept) THEN w.kept ELSE list_append(w.kept, w.rn + 1) END
    FROM wk w JOIN rk r ON r.match_id = w.match_id AND r.rn = w.rn + 1 LEFT JOIN cf ON cf.match_id = w.match_id AND cf.rn = w.rn + 1),
  fin AS (SELECT match_id, unnest(kept) AS rn FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY rn DESC) = 1)),
  nms AS (SELECT rk.* FROM fin JOIN rk USING (match_id, rn))"""


FIT = """SELECT * FROM moments_v WHERE selection_locked IS TRUE OR (keep_decision <> 'reject' AND semantic_verified IS NOT FALSE AND NOT angle_deferred AND NOT support_deferred AND (semantic_verified IS TRUE OR confidence >= 0.4e0))"""


@query("director_candidates", f"WITH RECURSIVE {nms_sql(FIT)} SELECT match_id, moment_id, importance FROM nms QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY importance DESC, ordinal) <= 180")
def _(v):
    return SEL.director_candidates(v.moments, 180).select("match_id", "moment_id", "importance")


@query("story_capacity", f"""WITH RECURSIVE {nms_sql('SELECT * FROM moments_v')} SELECT match_id, round(sum(CASE WHEN react THEN least(3000e0, end_ms - start_ms) ELSE least(12000e0, (end_ms - start_ms) / 0.72e0) + 1000 END), 3) AS capacity_ms FROM nms GROUP BY match_id""")
def _(v):
    return Q.story_capacity(v.moments)


@query("render_capacity", f"""WITH RECURSIVE {nms_sql('SELECT * FROM moments_v')} SELECT match_id, CAST(sum(CASE WHEN react THEN least(3000, end_ms - start_ms) ELSE least(30000, end_ms - start_ms) END) - (count(*) - 1) * 80 AS BIGINT) AS capacity_ms FROM nms GROUP BY match_id""")
def _(v):
    return Q.render_capacity(v.moments)


@query("rank_incidents", f"""SELECT match_id, story_id AS story, max({PRIO} + importance) AS priority, count(*) AS scenes, row_number() OVER (PARTITION BY match_id ORDER BY max({PRIO} + importance) DESC, min(ordinal)) AS rank
  FROM moments_v WHERE semantic_verified IS NOT FALSE AND action_complete IS NOT FALSE GROUP BY match_id, story_id HAVING bool_or(NOT {REACT})""")
def _(v):
    return SEL.rank_incidents(v.moments)


@query("story_score", """WITH t AS (SELECT match_id, story_id, sum(importance) AS best FROM (SELECT * FROM moments_v WHERE keep_decision <> 'reject' QUALIFY row_number() OVER (PARTITION BY match_id, story_id ORDER BY importance DESC, ordinal) <= 8) GROUP BY ALL),
  f AS (SELECT match_id, story_id, count(DISTINCT story_phase) AS ph, count(*) FILTER (ball_visible AND player_visible) AS vis, min(ordinal) AS fo FROM moments_v WHERE keep_decision <> 'reject' GROUP BY ALL)
  SELECT match_id, story_id AS story, best + ph * 18 + vis * 8 AS score, row_number() OVER (PARTITION BY match_id ORDER BY best + ph * 18 + vis * 8 DESC, fo) = 1 AS strongest FROM t JOIN f USING (match_id, story_id)""")
def _(v):
    return SEL.story_score(v.moments)


@query("chapter_order", f"""WITH r AS (SELECT *, CASE WHEN {REACT} THEN 2 WHEN is_replay OR story_phase = 'replay' THEN 1 ELSE 0 END AS phase_rank, min(start_ms) OVER w AS c0, min(ordinal) OVER w AS c1 FROM moments_v WINDOW w AS (PARTITION BY match_id, story_id))
  SELECT match_id, moment_id, story_id AS story, phase_rank, row_number() OVER (PARTITION BY match_id ORDER BY c0, c1, phase_rank, start_ms, ordinal) AS position FROM r""")
def _(v):
    return SEL.chapter_order(v.moments)


VQ = """(CASE WHEN semantic_verified THEN 120 ELSE 0 END + CASE WHEN action_complete THEN 90 ELSE 0 END + CASE WHEN ball_visible THEN 35 ELSE 0 END + CASE WHEN player_visible THEN 30 ELSE 0 END
  + CASE WHEN contact_ms IS NOT NULL THEN 18 ELSE 0 END + 18 + visual_clarity * 28 + completeness * 22 + confidence * 20 + importance * 0.12e0 - greatest(0, ordinal % 3 - 1) * 12)"""


def shots_counted(v):
    return v.moments.withColumn("shot_count", F.expr("ordinal % 3"))


@query("view_quality", f"SELECT moment_id, round({VQ}, 4) AS quality FROM moments_v")
def _(v):
    return shots_counted(v).select("moment_id", F.round(SEL.view_quality(), 4).alias("quality"))


@query("limit_views", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY match_id, story_id ORDER BY angle_selected DESC, {VQ} DESC, start_ms, ordinal) AS rn, bool_or(ordinal % 5 = 0) OVER (PARTITION BY match_id, story_id) AS fixed
    FROM moments_v WHERE event_type IN ('goal', 'disallowed_goal') AND keep_decision <> 'reject')
  SELECT m.moment_id, coalesce(rn > CASE WHEN fixed THEN 1 ELSE 2 END, false) AS removed FROM moments_v m LEFT JOIN p USING (match_id, moment_id)""")
def _(v):
    return SEL.limit_views(shots_counted(v).withColumn("live_first", F.expr("ordinal % 5 = 0"))).select("moment_id", "removed")


ACT = ", ".join(f"'{e}'" for e in SEL.ACTIONS)


@query("pick_clear_angle", f"""WITH c AS (SELECT *, 1 + ordinal % 4 AS cuts FROM moments_v WHERE (score_observation OR additional_action) AND event_type IN ({ACT}) AND NOT (score_observation AND event_type NOT IN ('goal', 'disallowed_goal'))
    AND NOT (additional_action AND NOT score_observation AND event_type IN ('goal', 'disallowed_goal')) AND action_complete AND semantic_verified IS NOT FALSE AND keep_decision <> 'reject'),
  r AS (SELECT *, row_number() OVER (PARTITION BY match_id, story_id ORDER BY CASE WHEN semantic_verified THEN 0 ELSE 1 END, CASE WHEN {LIVE} THEN 0 ELSE 1 END, cuts, start_ms, visual_clarity DESC, confidence DESC, ordinal) AS rank FROM c)
  SELECT match_id, story_id AS story, moment_id, rank, rank = 1 AS primary_view FROM r""")
def _(v):
    return SEL.pick_clear_angle(v.moments, v.moments.selectExpr("match_id", "moment_id", "1 + ordinal % 4 AS cuts")).withColumnRenamed("primary", "primary_view")


EV = ["match_id", "moment_id", "ordinal % 3 <> 1 AS usable", "CASE WHEN ordinal % 7 <> 0 THEN (ordinal % 50) / 1e1 END AS quality"]


def evidence(v):
    return v.moments.selectExpr(*EV)


@query("pick_tracked_angle", f"""WITH p AS (SELECT m.*, usable, quality, {VQ} AS vq FROM moments_v m JOIN (SELECT {', '.join(EV)} FROM moments_v) USING (match_id, moment_id) WHERE selection_locked AND event_type IN ('goal', 'disallowed_goal')),
  w AS (SELECT match_id, story_id, moment_id AS winner FROM p WHERE usable QUALIFY row_number() OVER (PARTITION BY match_id, story_id ORDER BY coalesce(quality, -1e300) DESC, vq DESC, start_ms, ordinal) = 1)
  SELECT match_id, story_id AS story, moment_id, coalesce(winner = moment_id, false) AS chosen, CASE WHEN winner = moment_id THEN 'best_tracked_incident_angle' WHEN winner IS NOT NULL THEN 'removed_after_incident_angle_comparison' ELSE 'incident_has_no_verified_angle' END AS decision
  FROM p LEFT JOIN w USING (match_id, story_id)""")
def _(v):
    return SEL.pick_tracked_angle(shots_counted(v), evidence(v))


@query("preflight_angles", f"""WITH p AS (SELECT m.*, usable, quality, event_type IN ('goal', 'disallowed_goal') AS g FROM moments_v m JOIN (SELECT {', '.join(EV)} FROM moments_v) USING (match_id, moment_id) WHERE selection_locked),
  w AS (SELECT match_id, story_id, moment_id AS winner FROM p WHERE usable AND g QUALIFY row_number() OVER (PARTITION BY match_id, story_id ORDER BY CASE WHEN angle_selected THEN 1e6 ELSE 0 END + coalesce(quality, 0) DESC, ordinal) = 1)
  SELECT match_id, story_id AS story, moment_id, CASE WHEN usable AND (NOT g OR winner = moment_id) THEN 'approved' WHEN usable THEN 'backup' ELSE 'rejected' END AS decision, g AND winner IS NULL AS incident_missing FROM p LEFT JOIN w USING (match_id, story_id)""")
def _(v):
    return SEL.preflight_angles(v.moments, evidence(v))


@query("recover_native", f"""WITH p AS (SELECT m.*, usable, quality FROM moments_v m JOIN (SELECT {', '.join(EV)} FROM moments_v) USING (match_id, moment_id) WHERE selection_locked AND event_type IN ('goal', 'disallowed_goal'))
  SELECT match_id, story_id AS story, moment_id FROM p WHERE semantic_verified AND action_complete AND ball_visible IS NOT FALSE AND player_visible IS NOT FALSE AND proof_verified
    AND (match_id, story_id) NOT IN (SELECT (match_id, story_id) FROM p WHERE usable) QUALIFY row_number() OVER (PARTITION BY match_id, story_id ORDER BY coalesce(quality, -1e300) DESC, start_ms, ordinal) = 1""")
def _(v):
    return SEL.recover_native(v.moments, evidence(v))


@query("section_quota", f"""WITH {PLAN_SQL}, r AS (SELECT m.match_id, moment_id, section, ordinal AS rank, event_type = 'goal' AND ordinal % 3 = 0 AS mandatory, least(6000, end_ms - m.start_ms) AS cap, requested_ms FROM moments_v m
     JOIN plan p ON p.match_id = m.match_id AND (m.start_ms + m.end_ms) / 2 >= p.start_ms AND (m.start_ms + m.end_ms) / 2 < p.core_end_ms),
  b AS (SELECT match_id, section, sum(cap) FILTER (mandatory) AS have FROM r GROUP BY ALL),
  o AS (SELECT r.*, have, coalesce(sum(cap) OVER (PARTITION BY r.match_id, r.section ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN b USING (match_id, section) WHERE NOT mandatory)
  SELECT match_id, moment_id, section FROM o WHERE coalesce(have, 0) + before < requested_ms UNION ALL SELECT match_id, moment_id, section FROM r WHERE mandatory""")
def _(v):
    plan = W.section_plan(src(v))
    rows = v.moments.join(K.section_of(v.moments, plan), ["match_id", "moment_id"]).selectExpr(
        "match_id", "moment_id", "section", "ordinal AS rank", "event_type = 'goal' AND ordinal % 3 = 0 AS mandatory", "least(6000, end_ms - start_ms) AS capacity_ms")
    return SEL.section_quota(rows, plan)


@query("schedule_tracking", f"""WITH c AS (SELECT match_id, story_id, CAST(sum(greatest(0, end_ms - greatest(start_ms, coalesce(reach, start_ms)))) AS BIGINT) AS cov FROM (SELECT *, max(end_ms) OVER (PARTITION BY match_id, story_id ORDER BY start_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM moments_v) GROUP BY ALL),
  g AS (SELECT match_id, story_id, max({PRIO} + importance) AS pr, min(ordinal) AS fo, bool_or(event_type = 'goal' AND ordinal % 4 = 0) AS decisive FROM moments_v GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pr DESC, fo) AS rank FROM g JOIN c USING (match_id, story_id)),
  o AS (SELECT *, coalesce(sum(CASE WHEN decisive THEN cov ELSE 0 END) OVER (PARTITION BY match_id), 0) AS fixed, coalesce(sum(CASE WHEN NOT decisive THEN cov ELSE 0 END) OVER (PARTITION BY match_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT match_id, story_id AS story, rank, decisive OR fixed + before < 80000 * 1.45e0 AS primary_group FROM o""")
def _(v):
    worth = S.lookup(S.INCIDENT_PRIORITY, F.col("event_type"), 0) + F.col("importance")
    g = v.moments.groupBy("match_id", "story_id").agg(F.max(worth).alias("pr"), F.min("ordinal").alias("fo"), F.bool_or(F.expr("event_type = 'goal' AND ordinal % 4 = 0")).alias("decisive"))
    cov = W.covered_seconds(v.moments, ["match_id", "story_id"])
    ranked = g.join(cov, ["match_id", "story_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("pr"), "fo"))).withColumnRenamed("story_id", "story")
    return SEL.schedule_tracking(ranked, v.sources.selectExpr("match_id", "80000 AS required_ms")).withColumnRenamed("primary", "primary_group")


@query("even_subset", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS len, 1 + match_id % 4 AS slots FROM beats_v)
  SELECT match_id, beat_id, i AS position FROM b WHERE len <= slots OR (slots = 1 AND i = 0) OR (slots > 1 AND i IN (SELECT CAST(floor(j * (len - 1) / nullif(slots - 1, 0) + 0.5e0) AS BIGINT) FROM (SELECT unnest(range(4)) AS j) WHERE j < slots))""")
def _(v):
    return SEL.even_subset(v.beats, v.beats.select("match_id").distinct().selectExpr("match_id", "1 + match_id % 4 AS slots"))


ZK = ["match_id", "scene_id", "t_ms", "k % 97 = 3 AS scene_cut", "k % 11 <> 0 AS ball_in_frame", "true AS player_in_frame", "0.5e0 + (ordinal % 40 - 20) / 256e0 * (scene_id % 2 + 1) AS bx", "0.5e0 + (ordinal % 36 - 18) / 128e0 AS b_y",
      "0.5e0 + (ordinal % 30 - 15) / 256e0 AS px", "0.5e0 + (ordinal % 52 - 26) / 64e0 * (match_id % 2) AS p_y"]


@query("safe_zoom", f"""WITH k AS (SELECT {', '.join(ZK)} FROM frames_v), g AS (SELECT match_id, scene_id, count(*) AS n, count(*) FILTER (ball_in_frame) AS s, bool_or(scene_cut AND t_ms > 150) AS cut,
    min(least(bx, px)) FILTER (ball_in_frame) AS x0, max(greatest(bx, px)) FILTER (ball_in_frame) AS x1, min(least(b_y, p_y)) FILTER (ball_in_frame) AS y0, max(greatest(b_y, p_y)) FILTER (ball_in_frame) AS y1 FROM k GROUP BY ALL),
  c AS (SELECT *, least(0.525e0, greatest(0.475e0, (x0 + x1) / 2)) AS cx, least(0.525e0, greatest(0.475e0, (y0 + y1) / 2)) AS cy,
    CASE WHEN n < 8 OR cut THEN 'insufficient_continuous_tracking' WHEN s < 8 OR s / n < 0.85e0 THEN 'ball_or_player_not_continuously_verified' WHEN x0 < 0 OR x1 > 1 OR y0 < 0 OR y1 > 1 THEN 'invalid_subject_position' END AS why FROM g),
  z AS (SELECT *, CASE WHEN why IS NOT NULL THEN 1e0 ELSE coalesce((SELECT max(z) FROM (VALUES (1.10e0), (1.08e0), (1.05e0)) t(z) WHERE x0 >= cx - 0.5e0 / z + 0.055e0 / z AND x1 <= cx + 0.5e0 / z - 0.055e0 / z AND y0 >= cy - 0.5e0 / z + 0.055e0 / z AND y1 <= cy + 0.5e0 / z - 0.055e0 / z), 1e0) END AS zoom FROM c)
  SELECT match_id, scene_id, zoom, coalesce(why, CASE WHEN zoom > 1 THEN 'verified_scene_safe' ELSE 'action_needs_full_width' END) AS reason FROM z""")
def _(v):
    return SEL.safe_zoom(v.frames.selectExpr(*ZK))


RP = ["match_id", "moment_id", "10 AS samples", "(ordinal % 13) / 128e0 AS max_step", "(ordinal % 10) / 8e0 AS setup_joint", "(ordinal % 7) / 8e0 AS contact_direct", "(ordinal % 6) / 8e0 AS setup_direct", "(ordinal % 5) / 4e0 AS goal_payoff", "ordinal % 3 AS flight_samples", "(ordinal % 11) / 8e0 AS flight_ball"]


@query("repair_priority", f"""WITH e AS (SELECT {', '.join(RP)} FROM moments_v WHERE ordinal % 8 <> 3), j AS (SELECT m.match_id, m.moment_id, event_type, semantic_verified, e.* EXCLUDE (match_id, moment_id), event_type = 'goal' AND setup_direct >= 0.45e0 AND contact_direct >= 0.35e0 AND goal_payoff >= 0.5e0 AS near FROM moments_v m LEFT JOIN e USING (match_id, moment_id))
  SELECT match_id, moment_id, round(CASE WHEN samples IS NULL OR semantic_verified IS NOT TRUE OR max_step > 0.08e0 OR setup_joint < CASE WHEN near THEN 0.45e0 ELSE 0.6e0 END OR contact_direct < 0.2e0 OR (flight_samples > 0 AND flight_ball < 0.5e0) THEN -1e0
    ELSE CASE WHEN event_type = 'goal' THEN 100 ELSE 0 END + setup_joint * 10 + contact_direct * 10 END, 4) AS priority FROM j""")
def _(v):
    return SEL.repair_priority(v.moments, v.moments.where("ordinal % 8 <> 3").selectExpr(*RP))


@query("fit_rate", PACK_SQL + """, s AS (SELECT match_id, (end_ms - start_ms)::DOUBLE AS len, playback_rate AS rate, CASE WHEN effect = 'freeze_analysis' THEN least(1000e0, greatest(400e0, freeze_ms)) ELSE 0 END
     - CASE WHEN row_number() OVER (PARTITION BY match_id ORDER BY start_ms, ordinal) > 1 THEN least(360e0, greatest(40e0, transition_ms)) ELSE 0 END AS extra FROM packed WHERE chosen),
  b(match_id, i, lo, hi) AS (SELECT match_id, 0, 1e0, 2e0 FROM (SELECT DISTINCT match_id FROM s) UNION ALL
    SELECT match_id, i + 1, CASE WHEN tot > 45000 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tot > 45000 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT b.match_id, i, lo, hi, t.tot FROM b JOIN LATERAL (SELECT sum(least(30000e0, len / least(1.18e0, greatest(0.72e0, rate * (b.lo + b.hi) / 2))) + extra) AS tot FROM s WHERE s.match_id = b.match_id) t ON true WHERE i < 32)),
  m AS (SELECT match_id, hi FROM b WHERE i = 32), x AS (SELECT match_id, sum(least(30000e0, len / least(1.18e0, greatest(0.72e0, rate))) + extra) AS t1, sum(least(30000e0, len / least(1.18e0, greatest(0.72e0, rate * 2))) + extra) AS t2 FROM s GROUP BY 1),
  f AS (SELECT match_id, CASE WHEN t1 <= 45000 THEN 1e0 WHEN t2 > 45000 THEN 2e0 ELSE hi END AS mu FROM m JOIN x USING (match_id))
  SELECT match_id, round(any_value(mu), 4) AS multiplier, round(sum(least(30000e0, len / least(1.18e0, greatest(0.72e0, rate * mu))) + extra), 1) AS planned_ms FROM s JOIN f USING (match_id) GROUP BY match_id""")
def _(v):
    return SEL.fit_rate(SEL.pack_timeline(scored(v), 60_000).where("selected"), 45_000)


EST = ["match_id", "moment_id", "ordinal", "start_ms", "coalesce(edit_order, 1000000) AS edit_key", "CASE WHEN ordinal % 9 = 0 THEN commentary END AS commentary", "end_ms - start_ms AS est_ms"]


@query("fit_selected", f"""WITH RECURSIVE e AS (SELECT {', '.join(EST)} FROM moments_v), q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY edit_key, start_ms, ordinal) AS rn FROM e WHERE commentary IS NULL),
  b AS (SELECT match_id, coalesce(sum(est_ms) FILTER (commentary IS NOT NULL), 0) AS told FROM e GROUP BY match_id),
  w(match_id, rn, total, moment_id, hit) AS (SELECT match_id, 0::BIGINT, CAST(told AS BIGINT), NULL::VARCHAR, false FROM b UNION ALL
    SELECT w.match_id, q.rn, CASE WHEN w.total + est_ms <= 93000 THEN w.total + est_ms ELSE w.total END, q.moment_id, w.total + est_ms <= 93000 FROM w JOIN q ON q.match_id = w.match_id AND q.rn = w.rn + 1)
  SELECT match_id, moment_id FROM w WHERE hit UNION ALL SELECT match_id, moment_id FROM e WHERE commentary IS NOT NULL""")
def _(v):
    return SEL.fit_selected(v.moments.selectExpr(*EST), 90_000)


@query("editable_seconds", f"""SELECT match_id, round(sum(CASE WHEN NOT {REACT} THEN least(30000e0, len / least(1.18e0, greatest(0.72e0, len / 30000e0))) ELSE 0 END) + least(18000e0, sum(CASE WHEN {REACT} THEN least(30000e0, len / least(1.18e0, greatest(0.84e0, len / 30000e0))) ELSE 0 END)), 2) AS editable_ms
  FROM (SELECT *, (end_ms - start_ms)::DOUBLE AS len FROM moments_v WHERE semantic_verified IS NOT FALSE AND keep_decision <> 'reject' AND coalesce(tracking_decision, '') <> 'not_tracked') GROUP BY match_id""")
def _(v):
    return Q.editable_seconds(v.moments)


PURPOSE = "CASE WHEN ordinal % 5 = 1 THEN concat('explains the crossing run ', CAST(ordinal % 9 AS STRING)) END"
SCREEN = "CASE WHEN ordinal % 6 = 2 THEN 'Goalkeeper saves volley' END"
PLAN_ROLE = "CASE WHEN ordinal % 10 = 3 THEN 'reaction' ELSE 'action' END"
PLANNED = f"(SELECT *, {PURPOSE} AS analysis_purpose, {SCREEN} AS screen_text, {PLAN_ROLE} AS role FROM moments_v WHERE selected)"
TOK = """SELECT DISTINCT match_id, moment_id, tok FROM (SELECT match_id, moment_id, CASE WHEN tok LIKE 'clear%' THEN 'clearance' WHEN tok LIKE 'cross%' THEN 'cross' WHEN tok LIKE 'defen%' THEN 'defense' WHEN tok LIKE 'attack%' THEN 'attack'
   WHEN tok LIKE 'celebr%' THEN 'celebration' WHEN tok LIKE 'dribbl%' THEN 'dribble' WHEN tok LIKE 'finish%' THEN 'finish' WHEN tok LIKE 'head%' THEN 'header' WHEN tok LIKE 'sav%' THEN 'save' WHEN tok LIKE 'shoot%' THEN 'shot' WHEN tok LIKE 'tackl%' THEN 'tackle'
   WHEN length(tok) > 4 AND tok LIKE '%s' THEN left(tok, -1) ELSE tok END AS tok FROM (SELECT match_id, moment_id, unnest(string_split_regex(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), '\\s+')) AS tok FROM {src}))
  WHERE length(tok) >= 4 AND tok NOT IN ('with', 'from', 'into', 'over', 'past', 'that', 'this', 'their', 'before', 'after', 'shows', 'showing', 'scene', 'clip', 'replay', 'player', 'ball', 'football', 'toward', 'towards', 'through')"""


@query("rank_backups", f"""WITH pl AS {PLANNED}, pt AS ({TOK.format(text="concat_ws(' ', description, commentary, analysis_purpose, screen_text)", src='pl')}), ct AS ({TOK.format(text='description', src='moments_v')}),
  ov AS (SELECT p.match_id, p.moment_id AS pid, c.moment_id AS cid, sum(CASE WHEN p.tok IN ('assist', 'clearance', 'cross', 'dribble', 'header', 'offside', 'save', 'shot', 'tackle', 'volley') THEN 18 WHEN length(p.tok) >= 7 THEN 10 ELSE 6 END) AS pts FROM pt p JOIN ct c ON p.match_id = c.match_id AND p.tok = c.tok GROUP BY ALL),
  sc AS (SELECT m.match_id, m.moment_id, max(CASE WHEN p.moment_id IS NULL THEN 0 WHEN p.moment_id = m.moment_id THEN -1 ELSE CASE WHEN p.story_id = m.story_id THEN 60 ELSE 0 END + CASE WHEN p.event_type = m.event_type THEN 8 ELSE 0 END
     - CASE WHEN (m.event_type = 'celebration' OR m.story_phase = 'reaction') AND NOT (p.event_type = 'celebration' OR p.story_phase = 'reaction' OR p.role = 'reaction') THEN 60 ELSE 0 END + coalesce(pts, 0) END) AS s
     FROM moments_v m LEFT JOIN pl p ON p.match_id = m.match_id LEFT JOIN ov ON ov.match_id = m.match_id AND pid = p.moment_id AND cid = m.moment_id GROUP BY ALL)
  SELECT match_id, moment_id, CAST(greatest(0, s) AS BIGINT) AS semantic_score FROM sc""")
def _(v):
    return SEL.rank_backups(v.moments.where("selected").withColumns(dict(analysis_purpose=F.expr(PURPOSE), screen_text=F.expr(SCREEN), role=F.expr(PLAN_ROLE))), v.moments)
