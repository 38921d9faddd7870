"""Queries joining moments with evidence, beats, guides, companions and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import text as TX
from matchspark.operators import incidents as I
from matchspark.operators import linking as K
from matchspark.operators import windows as W
from matchspark.plans.catalog.intervals import PLAN_SQL, src
from matchspark.plans.registry import query

LIVE = "NOT (is_replay OR story_phase = 'replay')"
REACT = "(event_type = 'celebration' OR story_phase = 'reaction')"
EVT = ["match_id", "scene_id", "frame AS event_no", "t_ms + 40 * (ordinal % 7) - 120 AS e_ms"]


@query("nearest_record", f"""WITH e AS (SELECT {', '.join(EVT)} FROM frames_v WHERE ordinal % 3 = 0), r AS (SELECT * FROM frames_v WHERE direct)
  SELECT e.match_id, e.scene_id, event_no, x.m.f AS frame, x.m.b AS ball_x FROM e LEFT JOIN LATERAL (SELECT arg_min(struct_pack(f := frame, b := ball_x), struct_pack(d := abs(t_ms - e_ms), t := t_ms)) AS m
    FROM r WHERE r.match_id = e.match_id AND r.scene_id = e.scene_id AND abs(t_ms - e_ms) <= 80) x ON true""")
def _(v):
    ev = v.frames.where("ordinal % 3 = 0").selectExpr(*EVT)
    return K.nearest_record(ev, v.frames.where("direct")).select("match_id", "scene_id", "event_no", "frame", "ball_x")


SMP = ["match_id", "CASE ordinal % 3 WHEN 0 THEN 'Soccer ball' WHEN 1 THEN 'player' ELSE 'tree' END AS label", "start_ms + 500 AS t_ms", "box_x1 AS x"]
TXT = ["match_id", "ordinal AS text_id", "CASE WHEN ordinal % 5 = 0 THEN '' ELSE description END AS text", "start_ms AS x_start_ms", "end_ms AS x_end_ms"]


@query("enrich_with_annotations", f"""WITH s AS (SELECT {', '.join(SMP)} FROM moments_v), t AS (SELECT {', '.join(TXT)} FROM moments_v WHERE ordinal % 5 <> 0),
  p AS (SELECT m.match_id, m.moment_id, count(*) FILTER (label = 'Soccer ball') AS ball_samples, count(*) FILTER (label = 'player') AS person_samples, median(x) FILTER (label = 'Soccer ball') AS bx, median(x) FILTER (label = 'player') AS px
     FROM moments_v m JOIN s ON s.match_id = m.match_id AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
  c AS (SELECT m.match_id, m.moment_id, count(*) AS shot_count FROM moments_v m JOIN shots_v h ON h.match_id = m.match_id AND shot_start_ms < end_ms AND shot_end_ms > start_ms GROUP BY ALL),
  w AS (SELECT m.match_id, m.moment_id, list(text ORDER BY x_start_ms, text_id) AS q FROM moments_v m JOIN t ON t.match_id = m.match_id AND x_start_ms < end_ms AND x_end_ms > start_ms GROUP BY ALL)
  SELECT match_id, moment_id, coalesce(ball_samples, 0) AS ball_samples, coalesce(person_samples, 0) AS person_samples, coalesce(bx, px, goal_focus_x) AS focus_x, coalesce(shot_count, 0) AS shot_count,
    coalesce(array_to_string(q[1:12], '|'), '') AS texts, coalesce(left(array_to_string(q, ' '), 700), '') AS transcript
  FROM moments_v LEFT JOIN p USING (match_id, moment_id) LEFT JOIN c USING (match_id, moment_id) LEFT JOIN w USING (match_id, moment_id)""")
def _(v):
    return K.enrich_with_annotations(v.moments, v.moments.selectExpr(*SMP), v.shots, v.moments.selectExpr(*TXT))


PHS = [("setup", 0, 900), ("contact", 900, 1200), ("flight", 1300, 2100), ("payoff", 2100, 9000)]


@query("label_frames", """SELECT match_id, scene_id, frame, CASE WHEN t_ms < 900 THEN 'setup' WHEN t_ms < 1200 THEN 'contact' WHEN t_ms < 1300 THEN NULL WHEN t_ms < 2100 THEN 'flight' ELSE 'payoff' END AS label FROM frames_v""")
def _(v):
    rows = ", ".join(f"struct('{n}' AS label, {a}L AS p_start_ms, {b}L AS p_end_ms)" for n, a, b in PHS)
    scenes = v.frames.select("match_id", "scene_id").distinct().selectExpr("match_id", "scene_id", f"inline(array({rows}))")
    return K.label_frames(v.frames.select("match_id", "scene_id", "frame", "t_ms"), scenes).drop("t_ms")


@query("ball_proximity", """SELECT b.match_id, b.scene_id, b.frame, b.idx, round(min(d), 4) AS near_any, round(coalesce(min(d) FILTER (ps >= 0.08e0), 1e0), 4) AS near_pitch FROM (
   SELECT b.*, p.pitch_support AS ps, sqrt(pow(p.cx - b.cx, 2) + pow((p.y2 - b.cy) * 0.52e0, 2)) AS d FROM balls_v b JOIN players_v p USING (match_id, scene_id, frame)) b GROUP BY ALL""")
def _(v):
    return K.ball_proximity(v.balls, v.players)


@query("touch_distance", """SELECT match_id, scene_id, frame, p.idx AS idx, b.idx AS ball, round(CASE WHEN b.cx BETWEEN p.x1 - 0.012e0 AND p.x2 + 0.012e0 AND b.cy BETWEEN p.y1 - 0.025e0 AND p.y1 + (p.y2 - p.y1) * 0.18e0
    THEN least(sqrt(pow(p.cx - b.cx, 2) + pow((p.y2 - b.cy) * 0.85e0, 2)), sqrt(pow(p.cx - b.cx, 2) + pow((p.y1 + (p.y2 - p.y1) * 0.08e0 - b.cy) * 0.85e0, 2)))
    ELSE sqrt(pow(p.cx - b.cx, 2) + pow((p.y2 - b.cy) * 0.85e0, 2)) END, 4) AS touch FROM players_v p JOIN balls_v b USING (match_id, scene_id, frame)""")
def _(v):
    return K.touch_distance(v.players, v.balls)


EVID = ["match_id", "moment_id", "start_ms + (ordinal % 5) * 14 AS ev_start_ms", "end_ms + (ordinal % 9) * 11 - 50 AS ev_end_ms"]


@query("match_evidence", f"""WITH e AS (SELECT {', '.join(EVID)} FROM moments_v WHERE ordinal % 6 <> 1)
  SELECT moment_id, ev_start_ms, ev_end_ms FROM moments_v JOIN e USING (match_id, moment_id) WHERE abs(ev_start_ms - start_ms) <= 41 AND CASE WHEN event_type = 'celebration' THEN end_ms <= ev_end_ms + 41 ELSE abs(ev_end_ms - end_ms) <= 41 END""")
def _(v):
    return K.match_evidence(v.moments, v.moments.where("ordinal % 6 <> 1").selectExpr(*EVID)).select("moment_id", "ev_start_ms", "ev_end_ms")


BEAT = ["match_id", "concat('beat-', CAST(ordinal AS STRING)) AS beat_id", "ordinal",
        "CASE ordinal % 4 WHEN 0 THEN concat(' ', moment_id) WHEN 2 THEN concat(story_id, '-x') ELSE moment_id END AS evidence_id"]
BEATS2 = ["match_id", "concat('again-', CAST(ordinal AS STRING)) AS beat_id", "ordinal + 1000000 AS ordinal", "moment_id AS evidence_id"]
BEATS_SQL = f"bts AS (SELECT {', '.join(BEAT)} FROM moments_v WHERE ordinal % 2 = 0 UNION ALL SELECT {', '.join(BEATS2)} FROM moments_v WHERE ordinal % 8 = 0)"


def named_beats(v):
    return v.moments.where("ordinal % 2 = 0").selectExpr(*BEAT).unionByName(v.moments.where("ordinal % 8 = 0").selectExpr(*BEATS2))


@query("bind_beats", f"WITH {BEATS_SQL} SELECT m.match_id, m.moment_id, arg_min(b.beat_id, b.ordinal) AS beat_id FROM moments_v m JOIN bts b ON b.match_id = m.match_id AND trim(b.evidence_id) = m.moment_id GROUP BY ALL")
def _(v):
    return K.bind_beats(named_beats(v), v.moments)


@query("binding_problems", f"""WITH {BEATS_SQL}, j AS (SELECT b.match_id, b.beat_id, m.moment_id, row_number() OVER (PARTITION BY b.match_id, m.moment_id ORDER BY b.ordinal) AS rn FROM bts b LEFT JOIN moments_v m ON b.match_id = m.match_id AND trim(b.evidence_id) = m.moment_id)
  SELECT match_id, beat_id, CASE WHEN moment_id IS NULL THEN 'unknown_id' ELSE 'id_reused' END AS problem FROM j WHERE moment_id IS NULL OR rn > 1""")
def _(v):
    return K.binding_problems(named_beats(v), v.moments)


CTX = ["match_id", "ordinal AS goal_id", "start_ms AS minute", "concat('Player ', CAST(ordinal % 50 AS STRING)) AS scorer"]
CTX_WHERE = "event_type = 'goal' AND ordinal % 3 <> 0"


@query("bind_identities", f"""WITH l AS (SELECT match_id, story_id, arg_min(moment_id, struct_pack(s := start_ms, o := ordinal)) AS moment_id, min(struct_pack(s := start_ms, o := ordinal)) AS at0 FROM moments_v
     WHERE event_type = 'goal' AND semantic_verified AND action_complete AND keep_decision <> 'reject' AND {LIVE} GROUP BY ALL),
  i AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY at0) AS n, count(*) OVER (PARTITION BY match_id) AS c FROM l),
  g AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY minute, goal_id) AS n, count(*) OVER (PARTITION BY match_id) AS c FROM (SELECT {', '.join(CTX)} FROM moments_v WHERE {CTX_WHERE}))
  SELECT match_id, n, story_id, moment_id, goal_id, scorer FROM i JOIN g USING (match_id, n, c)""")
def _(v):
    return K.bind_identities(v.moments.where(CTX_WHERE).selectExpr(*CTX), v.moments)


OKS = "semantic_verified AND action_complete AND keep_decision <> 'reject'"


@query("attach_reactions", f"""WITH ok AS (SELECT *, start_ms - CASE WHEN event_type = 'celebration' THEN start_ms % 60000 ELSE 0 END AS s2, end_ms - end_ms % 60000 AS e2 FROM moments_v WHERE {OKS})
  SELECT c.match_id, c.story_id, arg_min(c.moment_id, c.ordinal) AS moment_id FROM ok c WHERE event_type = 'celebration' AND EXISTS (SELECT 1 FROM ok g WHERE g.match_id = c.match_id AND g.story_id = c.story_id AND g.event_type = 'goal'
    AND c.s2 BETWEEN g.e2 - 100 AND g.e2 + 1000) GROUP BY ALL""")
def _(v):
    snapped = v.moments.withColumns(dict(
        start_ms=F.expr("start_ms - CASE WHEN event_type = 'celebration' THEN start_ms % 60000 ELSE 0 END"), end_ms=F.expr("end_ms - end_ms % 60000")))
    return K.attach_reactions(snapped)


@query("decision_windows", f"""SELECT m.match_id, m.moment_id, row_number() OVER (PARTITION BY m.match_id, m.moment_id ORDER BY d.ordinal) AS rn, d.moment_id AS decision_id, d.start_ms AS d_start_ms, d.end_ms AS d_end_ms
  FROM moments_v m JOIN moments_v d ON d.match_id = m.match_id AND d.story_id = m.story_id AND d.moment_id <> m.moment_id AND d.semantic_verified AND d.event_type IN ('var', 'offside', 'disallowed_goal') AND d.start_ms BETWEEN m.end_ms AND m.end_ms + 45000
  WHERE m.event_type IN ('goal', 'disallowed_goal') QUALIFY rn <= 3""")
def _(v):
    return K.decision_windows(v.moments)


@query("overturn_goals", """WITH d AS (SELECT * FROM moments_v WHERE semantic_verified AND event_type IN ('var', 'offside', 'disallowed_goal') AND ordinal % 2 = 0)
  SELECT m.match_id, m.moment_id, CASE WHEN x.id IS NOT NULL THEN 'disallowed_goal' ELSE event_type END AS event_type, x.id AS decision_id FROM moments_v m LEFT JOIN (
    SELECT g.match_id, g.moment_id, arg_min(d.moment_id, d.ordinal) AS id FROM moments_v g JOIN d ON d.match_id = g.match_id AND d.story_id = g.story_id AND d.moment_id <> g.moment_id AND d.start_ms BETWEEN g.start_ms AND g.end_ms + 45000
    WHERE g.event_type = 'goal' AND g.semantic_verified GROUP BY ALL) x USING (match_id, moment_id)""")
def _(v):
    rows = v.moments.withColumn("facts", F.expr("CASE WHEN ordinal % 2 = 0 THEN 'The goal is Ruled Out' ELSE 'the goal stands' END"))
    return K.overturn_goals(rows).select("match_id", "moment_id", "event_type", "decision_id")


# clocks snapped to a coarse grid so that same-action pairs occur
SNAP = ["match_id", "moment_id", "ordinal", "event_type", "story_phase", "semantic_verified", "action_complete", "keep_decision", "importance", "proof_verified",
        "start_ms - start_ms % 8000 AS start_ms", "end_ms - start_ms % 8000 AS end_ms", "contact_ms - start_ms % 8000 - (contact_ms - start_ms) % 1500 AS contact_ms",
        "proof_start_ms - start_ms % 8000 + 1000 - (proof_start_ms - start_ms) % 3000 AS proof_start_ms", "proof_end_ms - start_ms % 8000 AS proof_end_ms"]
PAIR_SQL = f"""sok AS (SELECT * FROM sn WHERE semantic_verified AND action_complete AND NOT {REACT} AND end_ms > start_ms AND proof_verified AND contact_ms BETWEEN start_ms AND end_ms AND proof_start_ms >= contact_ms AND proof_end_ms >= proof_start_ms AND proof_end_ms <= end_ms),
 same AS (SELECT a.match_id, a.moment_id AS a_id, b.moment_id AS b_id FROM sok a JOIN sok b ON a.match_id = b.match_id AND a.ordinal < b.ordinal AND abs(a.contact_ms - b.contact_ms) <= 350 AND abs(a.proof_start_ms - b.proof_start_ms) <= 500
    AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= least(a.end_ms - a.start_ms, b.end_ms - b.start_ms) * 0.35e0 AND least(a.proof_end_ms, b.proof_end_ms) >= greatest(a.proof_start_ms, b.proof_start_ms))"""
SAME_SQL = f"sn AS (SELECT {', '.join(SNAP)} FROM moments_v), {PAIR_SQL}"


@query("same_action_pairs", f"WITH {SAME_SQL} SELECT * FROM same")
def _(v):
    return K.same_action_pairs(v.moments.selectExpr(*SNAP))


#: From rows ``sn`` to ``fin`` joined with ``rk``: what is left after interval suppression.
UNIQUE_SQL = f"""{PAIR_SQL},
  ev AS MATERIALIZED (SELECT *, {REACT} AS react, CASE WHEN {REACT} THEN least(end_ms, start_ms + 3000) ELSE end_ms END AS cut FROM sn),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN semantic_verified AND action_complete IS NOT FALSE AND keep_decision <> 'reject' THEN 0 ELSE 1 END, CASE WHEN semantic_verified IS FALSE THEN 1 ELSE 0 END,
     importance DESC, end_ms - start_ms DESC, ordinal) AS rn FROM ev),
  cf AS MATERIALIZED (SELECT b.match_id, b.rn, list(a.rn) AS worse_than FROM rk a JOIN rk b ON a.match_id = b.match_id AND a.rn < b.rn AND a.react = b.react
     AND (greatest(0, least(a.cut, b.cut) - greatest(a.start_ms, b.start_ms)) >= least(a.cut - a.start_ms, b.cut - b.start_ms) * 0.8e0
       OR EXISTS (SELECT 1 FROM same s WHERE s.match_id = a.match_id AND ((s.a_id = a.moment_id AND s.b_id = b.moment_id) OR (s.a_id = b.moment_id AND s.b_id = a.moment_id)))) GROUP BY b.match_id, b.rn),
  wk AS (SELECT match_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT match_id FROM rk) UNION ALL
    SELECT w.match_id, w.rn + 1, CASE WHEN list_has_any(coalesce(cf.worse_than, []::BIGINT[]), w.kept) THEN w.kept ELSE list_append(w.kept, w.rn + 1) END
    FROM wk w JOIN rk r ON r.match_id = w.match_id AND r.rn = w.rn + 1 LEFT JOIN cf ON cf.match_id = w.match_id AND cf.rn = w.rn + 1),
  fin AS (SELECT match_id, unnest(kept) AS rn FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY rn DESC) = 1))"""


@query("unique_evidence", f"""WITH RECURSIVE sn AS (SELECT {', '.join(SNAP)} FROM moments_v), {UNIQUE_SQL}
  SELECT match_id, moment_id FROM fin JOIN rk USING (match_id, rn)""")
def _(v):
    return I.unique_evidence(v.moments.selectExpr(*SNAP))


@query("section_of", f"WITH {PLAN_SQL} SELECT m.match_id, moment_id, section FROM moments_v m JOIN plan p ON p.match_id = m.match_id AND (m.start_ms + m.end_ms) / 2 >= p.start_ms AND (m.start_ms + m.end_ms) / 2 < p.core_end_ms")
def _(v):
    return K.section_of(v.moments, W.section_plan(src(v)))


@query("missing_reviews", """WITH r AS (SELECT match_id, moment_id, r_verified, r_complete FROM reviews_v UNION ALL SELECT match_id, moment_id, r_verified, r_complete FROM reviews_v WHERE ordinal % 7 = 3),
  g AS (SELECT match_id, moment_id, count(*) AS n, bool_and(r_verified IS NOT NULL AND r_complete IS NOT NULL) AS f FROM r GROUP BY ALL)
  SELECT match_id, moment_id, coalesce(n, 0) AS returned FROM moments_v LEFT JOIN g USING (match_id, moment_id) WHERE NOT coalesce(n = 1 AND f, false)""")
def _(v):
    r = v.reviews.select("match_id", "moment_id", "ordinal", "r_verified", "r_complete")
    return K.missing_reviews(v.moments.select("match_id", "moment_id"), r.unionByName(r.where("ordinal % 7 = 3")).drop("ordinal"))


GUIDE = [("setup", "50", "ordinal % 5 <> 0", "ordinal % 3 <> 0"), ("contact", "300", "ordinal % 7 <> 0", "ordinal % 4 <> 0"), ("flight", "450", "ordinal % 2 = 0", "true"),
         ("payoff", "600", "ordinal % 6 <> 1", "true"), ("contact", "800", "ordinal % 9 = 2", "ordinal % 2 = 0")]
OUT = "CASE ordinal % 10 WHEN 0 THEN 'goal' WHEN 1 THEN 'save' WHEN 2 THEN 'wide' WHEN 3 THEN 'over' WHEN 4 THEN 'blocked' WHEN 5 THEN 'woodwork' WHEN 6 THEN 'pass' WHEN 7 THEN 'dribble' WHEN 8 THEN 'goal' ELSE 'uncertain' END"
GX = ["ordinal, *", f"{OUT} AS outcome", "ordinal % 3 <> 1 AS authoritative", "ordinal % 4 AS doubts", "end_ms + 400 AS window_end_ms"]
GUIDE_SQL = f"""gm AS (SELECT *, {OUT} AS outcome, ordinal % 3 <> 1 AS authoritative, ordinal % 2 AS doubts, end_ms + 400 AS window_end_ms, (end_ms - start_ms) // 1000 AS u FROM moments_v),
 ga AS ({' UNION ALL '.join(f"SELECT match_id, moment_id, {i} AS idx, start_ms + {p} * u AS t, '{ph}' AS phase, {b} AS ball, {pl} AS player, CASE WHEN {b} THEN ((ordinal * 13 + {i} * 331) % 1000) / 1024e0 END AS ball_x, CASE WHEN (ordinal + {i}) % 3 <> 0 THEN ((ordinal * 29) % 1000) / 1024e0 END AS goal_x FROM gm" for i, (ph, p, b, pl) in enumerate(GUIDE))})"""


def guided(v):
    rows = ", ".join(
        f"named_struct('t', start_ms + {p} * ((end_ms - start_ms) div 1000), 'phase', '{ph}', 'ball', {b}, 'player', {pl}, 'ball_x', CASE WHEN {b} THEN ((ordinal * 13 + {i} * 331) % 1000) / 1024e0 END, 'goal_x', CASE WHEN (ordinal + {i}) % 3 <> 0 THEN ((ordinal * 29) % 1000) / 1024e0 END)"
        for i, (ph, p, b, pl) in enumerate(GUIDE))
    return v.moments.selectExpr("*", f"{OUT} AS outcome", "ordinal % 3 <> 1 AS authoritative", "ordinal % 2 AS doubts", "end_ms + 400 AS window_end_ms", f"array({rows}) AS guide")


@query("guided_bounds", f"""WITH {GUIDE_SQL}, c0 AS (SELECT match_id, moment_id, min(t) AS c FROM ga WHERE phase = 'contact' AND ball AND player GROUP BY ALL),
  pf AS (SELECT match_id, moment_id, min(t) AS p FROM ga JOIN c0 USING (match_id, moment_id) WHERE phase = 'payoff' AND ball AND t > c GROUP BY ALL),
  ct AS (SELECT match_id, moment_id, max(t) AS k, min(t) AS f FROM ga JOIN pf USING (match_id, moment_id) WHERE phase = 'contact' AND ball AND player AND t < p GROUP BY ALL),
  st AS (SELECT match_id, moment_id, min(t) AS s FROM ga JOIN ct USING (match_id, moment_id) WHERE phase IN ('setup', 'flight', 'contact') AND ball AND player AND t < k GROUP BY ALL),
  j AS (SELECT *, event_type IN ('goal', 'disallowed_goal') AS sc, least(window_end_ms, greatest(end_ms, p + 500)) AS e FROM gm LEFT JOIN pf USING (match_id, moment_id) LEFT JOIN ct USING (match_id, moment_id) LEFT JOIN st USING (match_id, moment_id)),
  r AS (SELECT *, CASE WHEN {REACT} THEN NULL WHEN sc AND outcome <> 'goal' AND NOT (outcome IN ('save', 'wide', 'over', 'blocked', 'woodwork') AND authoritative AND doubts = 0 AND k IS NOT NULL AND p IS NOT NULL) THEN 'source_goal_outcome_unresolved'
     WHEN NOT sc AND outcome = 'goal' THEN 'optional_action_goal_context_conflict'
     WHEN outcome = 'uncertain' OR k IS NULL OR p IS NULL OR (s IS NULL AND NOT coalesce(semantic_verified AND action_complete AND origin_ms < k, false)) THEN 'source_action_has_no_observed_complete_phases'
     WHEN e - start_ms < 500 THEN 'source_action_too_short' END AS reason FROM j),
  u AS (SELECT *, reason IS NULL AND NOT {REACT} AS usable FROM r)
  SELECT match_id, moment_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN usable THEN e ELSE end_ms END END AS end_ms,
    CASE WHEN reason IS NULL THEN CASE WHEN usable THEN CASE outcome WHEN 'save' THEN 'save' WHEN 'wide' THEN 'shot_off_target' WHEN 'over' THEN 'shot_off_target' WHEN 'blocked' THEN 'big_chance' WHEN 'woodwork' THEN 'big_chance'
      WHEN 'pass' THEN 'normal_play' WHEN 'dribble' THEN 'dribble' ELSE event_type END ELSE event_type END END AS event_type,
    CASE WHEN usable THEN greatest(start_ms, coalesce(s, origin_ms)) END AS origin_ms, CASE WHEN usable THEN k END AS contact_ms, CASE WHEN usable THEN f END AS flight_ms, CASE WHEN usable THEN p END AS payoff_ms FROM u""")
def _(v):
    return K.guided_bounds(guided(v))


@query("guide_brief", f"""WITH {GUIDE_SQL}, s AS (SELECT match_id, moment_id, min(struct_pack(t := t, x := ball_x)) AS f FROM ga WHERE ball_x IS NOT NULL GROUP BY ALL),
  c AS (SELECT match_id, moment_id, min(t) AS c0, max(struct_pack(t := t, x := ball_x)) AS c1 FROM ga WHERE ball_x IS NOT NULL AND phase = 'contact' GROUP BY ALL),
  fl AS (SELECT match_id, moment_id, min(t) AS ft FROM ga WHERE ball_x IS NOT NULL AND phase = 'flight' GROUP BY ALL), n AS (SELECT * FROM ga WHERE phase = 'payoff' AND goal_x IS NOT NULL),
  j AS (SELECT gm.*, f, c0, c1, ft, n.t AS nt, n.goal_x AS gx, n.ball_x AS bx, outcome IN ('goal', 'save', 'wide', 'over', 'blocked', 'woodwork') AND n.t IS NOT NULL AND c1 IS NOT NULL AS shot, event_type = 'goal' AND outcome = 'goal' AS rg
     FROM gm LEFT JOIN s USING (match_id, moment_id) LEFT JOIN c USING (match_id, moment_id) LEFT JOIN fl USING (match_id, moment_id) LEFT JOIN n USING (match_id, moment_id)),
  d AS (SELECT *, CASE WHEN rg THEN gx ELSE coalesce(bx, gx) END AS dest FROM j)
  SELECT match_id, moment_id, CASE WHEN f.t - start_ms <= 800 THEN f.x END AS opening_x, c1.t AS contact_ms, CASE WHEN c1 IS NOT NULL THEN least(c0, coalesce(ft, c0)) END AS flight_ms, CASE WHEN shot THEN dest END AS goal_focus_x,
   CASE WHEN shot THEN CASE WHEN dest > c1.x THEN 'right' ELSE 'left' END END AS attack_direction, CASE WHEN shot THEN nt END AS payoff_start_ms, shot AND rg AS proof FROM d""")
def _(v):
    return K.guide_brief(guided(v))


@query("team_lookup", """WITH c AS (SELECT regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9]', '', 'g')[1:15] AS key, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1)
  SELECT o_orderkey AS name_id, CASE WHEN n = 1 THEN id END AS team_id FROM orders LEFT JOIN c ON key = regexp_replace(lower('CUSTOMER #' || lpad(CAST(o_custkey % 900 * 10 AS VARCHAR), 9, '0')), '[^a-z0-9]', '', 'g')[1:15]""")
def _(v):
    catalog = v.parquet("customer").select(F.substring("c_name", 1, 16).alias("name"), F.col("c_custkey").alias("team_id"))
    names = v.parquet("orders").select(F.col("o_orderkey").alias("name_id"), F.expr("substring(concat('CUSTOMER #', lpad(CAST(o_custkey % 900 * 10 AS STRING), 9, '0')), 1, 17)").alias("name"))
    return TX.team_lookup(names, catalog)


@query("raw_scoring_obligations", f"""SELECT match_id, moment_id, concat('story-', CAST(floor((ordinal % 7 * 90500) / 1000e0 + 0.5e0) AS BIGINT), '-', replace(story_id || '/' || ordinal % 3, '/', '-')) AS story_id, event_type,
   start_ms + ordinal % 7 * 90500 AS start_ms, end_ms + ordinal % 7 * 90500 AS end_ms, contact_ms + ordinal % 7 * 90500 AS contact_ms, (is_replay OR story_phase = 'replay') AS is_replay
  FROM moments_v WHERE event_type IN ('goal', 'disallowed_goal') AND story_phase <> 'reaction' AND ordinal % 6 <> 5 AND ordinal % 9 <> 8""")
def _(v):
    d = v.moments.selectExpr("*", "CASE WHEN ordinal % 6 = 5 THEN 'save' ELSE event_type END AS outcome", "ordinal % 9 <> 8 AS result_seen", "ordinal % 7 * 90500 AS section_ms")
    return I.raw_scoring_obligations(d.withColumn("story_id", F.expr("concat(story_id, '/', CAST(ordinal % 3 AS STRING))")))


ROLE = f"CASE WHEN {REACT} THEN 'reactions' WHEN is_replay OR story_phase = 'replay' THEN 'replays' ELSE 'actions' END"


@query("incident_manifest", f"SELECT match_id, story_id AS story, {ROLE} AS role, count(*) AS scenes, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) FILTER (semantic_verified) AS verified FROM moments_v GROUP BY ALL")
def _(v):
    return I.incident_manifest(v.moments)


@query("incident_members", f"SELECT match_id, story_id AS story, {ROLE} AS role, moment_id, coalesce(semantic_verified, false) AS verified, coalesce(tracking_decision, keep_decision) AS decision, reject_reason FROM moments_v")
def _(v):
    return I.manifest_members(v.moments)


@query("dedup_keyframes", "SELECT match_id, scene_id, t_ms // 300 * 300 AS t_ms, arg_max(camera_x, ordinal) AS camera_x, max(ordinal) AS ordinal FROM frames_v WHERE ordinal % 5 <> 1 GROUP BY ALL")
def _(v):
    k = v.frames.selectExpr("match_id", "scene_id", "t_ms div 300 * 300 AS t_ms", "CASE WHEN ordinal % 5 = 1 THEN double('NaN') ELSE camera_x END AS camera_x", "ordinal")
    return I.dedup_keyframes(k)


@query("signature", """SELECT moment_id, sha256('{"end_ms":' || end_ms || ',"event_type":"' || event_type || '","start_ms":' || start_ms || CASE WHEN reject_reason IS NOT NULL THEN ',"z_reason":"' || reject_reason || '"' ELSE '' END || '}') AS signature FROM moments_v""")
def _(v):
    return I.signature(v.moments.withColumnRenamed("reject_reason", "z_reason"), ["start_ms", "end_ms", "event_type", "z_reason"]).select("moment_id", "signature")


@query("dedup_sources", """WITH u AS (SELECT url, page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT host, arg_min(url, page_id) AS url FROM u WHERE host <> '' GROUP BY host""")
def _(v):
    return I.dedup_sources(v.parquet("pages").select("url", F.col("page_id").alias("ordinal")))


@query("compact_observations", "SELECT match_id, story_id AS moment_id, story_phase AS phase, start_ms // 60000 AS t_ms, event_type AS description, min(ordinal) AS ordinal FROM moments_v GROUP BY ALL")
def _(v):
    return I.compact_observations(v.moments.selectExpr("match_id", "story_id AS moment_id", "story_phase AS phase", "start_ms div 60000 AS t_ms", "event_type AS description", "ordinal"))


RV = ["*", "CASE ordinal % 4 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE 'm' END AS r_model", "CASE WHEN ordinal % 5 = 0 THEN NULL ELSE 1 END AS r_contract", "18 + ordinal % 3 % 2 AS r_version",
      "CASE WHEN ordinal % 7 = 0 THEN 'x' ELSE story_id END AS r_signature", "story_id AS signature"]


@query("needs_review", """SELECT moment_id FROM moments_v WHERE ordinal % 4 IN (0, 1) OR (event_type = 'celebration' AND ordinal % 5 = 0) OR 18 + ordinal % 3 % 2 <> 19 OR ordinal % 7 = 0""")
def _(v):
    return I.needs_review(v.moments.selectExpr(*RV), "m", 19).select("moment_id")


@query("reuse_responses", """SELECT request_id FROM requests_v WHERE coalesce(model, 'none') IN ('click', 'view') AND label || request_id % 50 IN (SELECT label || request_id % 50 FROM requests_v WHERE request_id % 11 = 3)""")
def _(v):
    saved = v.requests.selectExpr("request_id", "coalesce(model, 'none') AS profile", "label", "request_id % 50 AS input_key")
    return I.reuse_responses(saved, v.requests.where("request_id % 11 = 3").selectExpr("label", "request_id % 50 AS input_key"), ["click", "view"]).select("request_id")


@query("box_nms", """WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id, scene_id, frame, role ORDER BY confidence DESC, idx) AS rn FROM (SELECT match_id, scene_id, frame, role, idx, confidence, cx / 4 AS x1, cy / 4 AS y1, cx / 4 + 0.2e0 AS x2, cy / 4 + 0.3e0 AS y2 FROM players_v)),
  wk AS (SELECT match_id, scene_id, frame, role, 0::BIGINT AS rn, []::STRUCT(i BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM d WHERE rn = 1 UNION ALL
    SELECT w.match_id, w.scene_id, w.frame, w.role, d.rn, CASE WHEN len([k FOR k IN w.kept IF greatest(0, least(k.x2, d.x2) - greatest(k.x1, d.x1)) * greatest(0, least(k.y2, d.y2) - greatest(k.y1, d.y1))
        / greatest(1e-9, (k.x2 - k.x1) * (k.y2 - k.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - greatest(0, least(k.x2, d.x2) - greatest(k.x1, d.x1)) * greatest(0, least(k.y2, d.y2) - greatest(k.y1, d.y1))) > 0.5e0]) > 0 THEN w.kept
      ELSE list_append(w.kept, struct_pack(i := d.idx, x1 := d.x1, y1 := d.y1, x2 := d.x2, y2 := d.y2)) END
    FROM wk w JOIN d ON d.match_id = w.match_id AND d.scene_id = w.scene_id AND d.frame = w.frame AND d.role = w.role AND d.rn = w.rn + 1)
  SELECT match_id, scene_id, frame, role, x.i AS idx FROM (SELECT match_id, scene_id, frame, role, unnest(kept) AS x FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY match_id, scene_id, frame, role ORDER BY rn DESC) = 1))""")
def _(v):
    return I.box_nms(v.players.selectExpr("match_id", "scene_id", "frame", "role", "idx", "confidence", "cx / 4 AS x1", "cy / 4 AS y1", "cx / 4 + 0.2e0 AS x2", "cy / 4 + 0.3e0 AS y2"))


ANGLE = ["match_id", "moment_id", "ordinal", "story_id", "event_type", "story_phase", "start_ms", "end_ms", "score_observation", "semantic_verified", "action_complete", "is_replay",
         "CASE WHEN ordinal % 7 = 2 THEN concat('a', story_id) END AS anchor_id", "CASE WHEN ordinal % 3 <> 0 THEN 1 + ordinal % 4 END AS segments"]


@query("alternate_angles", f"""WITH m AS (SELECT {', '.join(ANGLE)} FROM moments_v),
  o AS (SELECT * FROM m WHERE event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance') AND (score_observation IS TRUE OR semantic_verified IS TRUE) AND action_complete IS TRUE AND end_ms > start_ms AND end_ms - start_ms <= 30000),
  p AS (SELECT m.match_id, m.moment_id, o.moment_id AS o_id, o.start_ms AS os, o.end_ms AS oe, o.is_replay IS TRUE OR coalesce(o.story_phase = 'replay', false) AS orep,
    CASE WHEN o.semantic_verified IS TRUE THEN 0 ELSE 1 END AS c1, coalesce(o.segments, 1) AS c2, abs(o.start_ms - m.start_ms) AS c3, o.ordinal AS c4
    FROM m JOIN o ON m.match_id = o.match_id AND CASE WHEN m.anchor_id IS NOT NULL THEN o.anchor_id = m.anchor_id ELSE o.story_id = m.story_id END
    WHERE m.moment_id <> o.moment_id AND least(o.end_ms, m.end_ms) - greatest(o.start_ms, m.start_ms) <= 250),
  a1 AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match_id, moment_id ORDER BY c1, c2, c3, c4) = 1),
  p2 AS (SELECT p.* FROM p JOIN a1 ON p.match_id = a1.match_id AND p.moment_id = a1.moment_id WHERE p.o_id <> a1.o_id AND least(p.oe, a1.oe) - greatest(p.os, a1.os) <= 250),
  a2 AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY match_id, moment_id ORDER BY c1, c2, c3, c4) = 1)
  SELECT match_id, moment_id, place, o_id AS angle_id, os AS angle_start_ms, oe AS angle_end_ms, orep AS angle_replay FROM (SELECT *, 1 AS place FROM a1 UNION ALL SELECT *, 2 AS place FROM a2)""")
def _(v):
    return K.alternate_angles(v.moments.selectExpr(*ANGLE))
