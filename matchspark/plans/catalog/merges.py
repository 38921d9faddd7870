"""Queries merging newer observations, replacements and beats into saved rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import merges as G
from matchspark.plans.catalog.linking import GUIDE_SQL, guided
from matchspark.plans.registry import query

FL = "setup_visible AND contact_visible AND payoff_visible AND clean_bounds"


@query("merge_reviews", f"""WITH j AS (SELECT m.*, r.* EXCLUDE (match_id, moment_id, ordinal), coalesce(r_event_type, event_type) AS ev, coalesce(r_is_replay, is_replay) AS rp, coalesce(r_phase, story_phase) AS ph, 17 + m.ordinal % 5 AS version FROM moments_v m LEFT JOIN reviews_v r ON r.match_id = m.match_id AND r.moment_id = m.moment_id),
  k AS (SELECT *, coalesce(selection_locked IS NOT TRUE AND r_verified AND {FL} AND w_start_ms >= w_review_start_ms AND w_end_ms <= w_review_end_ms + 1 AND w_end_ms > w_start_ms, false) AS mv, r_verified IS FALSE AS dn,
    coalesce(r_verified AND (tracking_decision = 'semantic_mismatch' OR (tracking_decision IS NULL AND semantic_verified IS FALSE)) AND selection_locked IS NOT TRUE AND r_version >= version, false) AS ro FROM j)
  SELECT match_id, moment_id, ev AS event_type, rp AS is_replay, CASE WHEN ev NOT IN ('celebration', 'var') AND ph = 'reaction' THEN CASE WHEN rp THEN 'replay' ELSE 'action' END ELSE ph END AS story_phase, coalesce(r_verified, semantic_verified) AS semantic_verified, coalesce(r_complete, action_complete) AS action_complete,
   CASE WHEN mv THEN w_start_ms ELSE start_ms END AS start_ms, CASE WHEN mv THEN w_end_ms ELSE end_ms END AS end_ms, CASE WHEN dn THEN 'reject' WHEN ro THEN CASE WHEN rp THEN 'replay' ELSE 'keep' END ELSE keep_decision END AS keep_decision,
   CASE WHEN dn THEN 'semantic_mismatch' WHEN NOT ro THEN tracking_decision END AS tracking_decision, CASE WHEN dn THEN r_reject_reason WHEN NOT ro THEN reject_reason END AS reject_reason FROM k""")
def _(v):
    return G.merge_reviews(v.moments.withColumn("version", F.expr("17 + ordinal % 5")), v.reviews)


@query("apply_review_window", f"""WITH j AS (SELECT m.match_id, m.moment_id, m.start_ms, m.end_ms, m.selection_locked, r.* EXCLUDE (match_id, moment_id, ordinal), w_start_ms - source_start_ms AS s, w_end_ms - source_start_ms AS e FROM moments_v m JOIN reviews_v r ON r.match_id = m.match_id AND r.moment_id = m.moment_id),
  k AS (SELECT *, selection_locked IS TRUE OR r_verified IS NOT TRUE OR r_complete IS NOT TRUE OR r_event_type IN ('celebration', 'var', 'offside') AS sk, {FL} AS fl, {FL} AND s >= 0 AND w_end_ms <= source_end_ms + 1 AND e > s + 100 AND rel_contact_ms >= s AND rel_payoff_start_ms >= rel_contact_ms AND rel_payoff_start_ms < e AND rel_payoff_end_ms > rel_payoff_start_ms AND rel_payoff_end_ms <= e + 1 AS ok FROM j),
  t AS (SELECT *, CASE WHEN sk THEN 'unchanged' WHEN ok THEN 'replaced' ELSE 'unproven' END AS state FROM k)
  SELECT match_id, moment_id, state, CASE state WHEN 'replaced' THEN w_start_ms WHEN 'unchanged' THEN start_ms END AS start_ms, CASE state WHEN 'replaced' THEN w_end_ms WHEN 'unchanged' THEN end_ms END AS end_ms, NOT sk AND NOT fl AS conflicting FROM t""")
def _(v):
    return G.apply_review_window(v.moments, v.reviews)


@query("reject_non_play", """SELECT match_id, moment_id, CASE WHEN ordinal % 5 = 0 AND r_event_type NOT IN ('celebration', 'var', 'offside') THEN 'synthetic_reaction_mismatch' ELSE 'normal_play_without_ball' END AS reason FROM reviews_v
  WHERE (ordinal % 5 = 0 AND r_event_type NOT IN ('celebration', 'var', 'offside')) OR (r_event_type = 'normal_play' AND ordinal % 4 = 1)""")
def _(v):
    m = v.moments.selectExpr("match_id", "moment_id", "CASE WHEN ordinal % 5 = 0 THEN 'candidate reaction window immediately following a verified live goal' ELSE 'seen' END AS completion_reason")
    r = v.reviews.selectExpr("*", "array(named_struct('phase', 'setup', 'subjects', array('player')), named_struct('phase', 'flight', 'subjects', array(CASE WHEN ordinal % 4 = 1 THEN 'crowd' ELSE 'ball' END))) AS required")
    return G.reject_non_play(m, r)


NEW = ["match_id", "moment_id", "CASE WHEN ordinal % 11 = 0 THEN 'other' ELSE story_id END AS story_id", "CASE WHEN ordinal % 5 = 0 THEN 'save' ELSE event_type END AS event_type", "start_ms + 100 AS start_ms", "end_ms + 50 AS end_ms"]


@query("merge_replacements", """WITH k AS (SELECT *, ordinal % 3 = 0 AS has, CASE WHEN ordinal % 3 = 0 THEN CASE WHEN selection_locked IS NOT TRUE OR ordinal % 11 = 0 THEN 'identity_changed' WHEN event_type = 'goal' AND ordinal % 5 = 0 THEN 'goal_dropped' END END AS bad FROM moments_v)
  SELECT match_id, moment_id, bad AS violation, CASE WHEN has AND bad IS NULL AND ordinal % 5 = 0 THEN 'save' ELSE event_type END AS event_type, CASE WHEN has AND bad IS NULL THEN start_ms + 100 ELSE start_ms END AS start_ms, CASE WHEN has AND bad IS NULL THEN end_ms + 50 ELSE end_ms END AS end_ms FROM k""")
def _(v):
    return G.merge_replacements(v.moments, v.moments.where("ordinal % 3 = 0").selectExpr(*NEW))


@query("merge_missing", """WITH s AS (SELECT match_id, moment_id, ordinal, true AS verdict, true AS complete FROM moments_v WHERE ordinal % 4 <> 1), c AS (SELECT match_id, moment_id, ordinal, false AS verdict, CASE WHEN ordinal % 7 <> 0 THEN true END AS complete FROM moments_v WHERE ordinal % 5 = 1 OR ordinal % 4 = 1),
  g AS (SELECT match_id, moment_id, verdict, complete FROM c WHERE complete IS NOT NULL AND ordinal % 9 <> 0) SELECT match_id, moment_id, verdict, complete FROM s WHERE (match_id, moment_id) NOT IN (SELECT (match_id, moment_id) FROM g) UNION ALL SELECT * FROM g""")
def _(v):
    saved = v.moments.where("ordinal % 4 <> 1").selectExpr("match_id", "moment_id", "true AS verdict", "true AS complete")
    fix = v.moments.where("ordinal % 5 = 1 OR ordinal % 4 = 1").selectExpr("match_id", "moment_id", "ordinal", "false AS verdict", "CASE WHEN ordinal % 7 <> 0 THEN true END AS complete")
    return G.merge_missing(saved, fix.unionByName(fix.where("ordinal % 9 = 0")).drop("ordinal"))


BE = ["match_id", "moment_id", "start_ms + CASE WHEN ordinal % 6 = 0 THEN 1 ELSE 0 END AS ev_start_ms", "end_ms AS ev_end_ms", "ordinal % 3 <> 1 AS crop_verified", "ordinal % 7 <> 2 AS geometry_verified"]


@query("blocked_scenes", "SELECT match_id, moment_id FROM moments_v WHERE selection_locked AND NOT (ordinal % 6 <> 0 AND ordinal % 3 <> 1 AND ordinal % 7 <> 2 AND ordinal % 10 <> 5)")
def _(v):
    return G.blocked_scenes(v.moments, v.moments.where("ordinal % 10 <> 5").selectExpr(*BE)).select("match_id", "moment_id")


BTS = ["match_id", "concat('beat-', CAST(i AS STRING)) AS beat_id", "i AS ordinal", "concat('Beat  TEXT ', CAST(i % 9 AS STRING), ' ') AS narration"]


@query("restore_beat_order", """WITH b AS (SELECT match_id, 'beat-' || i AS beat_id, i, 'beat text ' || i % 9 AS k FROM sources_v, (SELECT unnest(range(14)) AS i)), t AS (SELECT match_id, k, arg_max(beat_id, i) AS tb FROM b GROUP BY ALL),
  r AS (SELECT m.*, CASE WHEN commentary IS NOT NULL THEN coalesce(tb, b.beat_id) END AS got FROM moments_v m LEFT JOIN t ON t.match_id = m.match_id AND t.k = m.commentary LEFT JOIN b ON b.match_id = m.match_id AND b.beat_id = m.beat_id WHERE selected),
  f AS (SELECT match_id, got, arg_min(moment_id, struct_pack(e := coalesce(edit_order, 1073741824), o := ordinal)) AS moment_id FROM r WHERE got IS NOT NULL GROUP BY ALL) SELECT r.match_id, r.moment_id, f.got AS beat_id FROM r LEFT JOIN f ON f.match_id = r.match_id AND f.moment_id = r.moment_id""")
def _(v):
    beats = v.sources.selectExpr("match_id", "explode(sequence(0, 13)) AS i").selectExpr(*BTS)
    return G.restore_beat_order(v.moments, beats)


@query("apply_replacement", f"""WITH {GUIDE_SQL}, p AS (SELECT *, start_ms + CASE WHEN ordinal % 9 = 8 THEN 60000 ELSE 10 END AS ps, CASE WHEN ordinal % 13 = 5 THEN start_ms + 200 ELSE end_ms + 100 END + CASE WHEN ordinal % 9 = 8 THEN 60000 ELSE 0 END AS pe FROM gm),
  i AS (SELECT g.match_id, g.moment_id, CASE WHEN p.ordinal % 9 = 8 THEN t + 60000 ELSE t END AS t, phase, ball, player FROM ga g JOIN p USING (match_id, moment_id)), q AS (SELECT i.*, ps, pe FROM i JOIN p USING (match_id, moment_id) WHERE t BETWEEN ps AND pe),
  c0 AS (SELECT match_id, moment_id, min(t) AS c FROM q WHERE phase = 'contact' AND ball AND player GROUP BY ALL), pf AS (SELECT match_id, moment_id, min(t) AS pay FROM q JOIN c0 USING (match_id, moment_id) WHERE phase = 'payoff' AND ball AND t > c GROUP BY ALL),
  ct AS (SELECT match_id, moment_id, max(t) AS k FROM q JOIN pf USING (match_id, moment_id) WHERE phase = 'contact' AND ball AND player AND t < pay GROUP BY ALL), su AS (SELECT DISTINCT match_id, moment_id, true AS su FROM q JOIN ct USING (match_id, moment_id) WHERE phase IN ('setup', 'contact', 'flight') AND ball AND player AND t < k),
  r AS (SELECT *, least(pe, pay + 500) AS e, CASE WHEN pe - ps < 500 THEN 'no_complete_replacement' WHEN su IS NULL OR pay IS NULL OR doubts > 0 THEN 'replacement_lacks_phases' WHEN event_type = 'goal' AND outcome <> 'goal' THEN 'goal_replaced_by_non_goal' WHEN least(pe, pay + 500) <= start_ms OR ps >= end_ms THEN 'other_incident' END AS why
    FROM p LEFT JOIN pf USING (match_id, moment_id) LEFT JOIN su USING (match_id, moment_id)) SELECT match_id, moment_id, why AS reason, CASE WHEN why IS NULL THEN ps END AS start_ms, CASE WHEN why IS NULL THEN e END AS end_ms FROM r""")
def _(v):
    far = F.when(F.expr("ordinal % 9 = 8"), 60_000).otherwise(0)
    rows = guided(v).withColumns(dict(
        pick_start_ms=F.expr("start_ms + CASE WHEN ordinal % 9 = 8 THEN 60000 ELSE 10 END"), pick_end_ms=F.expr("CASE WHEN ordinal % 13 = 5 THEN start_ms + 200 ELSE end_ms + 100 END") + far,
        guide=F.transform("guide", lambda a: F.struct((a["t"] + far).alias("t"), a["phase"].alias("phase"), a["ball"].alias("ball"), a["player"].alias("player")))))
    return G.apply_replacement(rows)


@query("render_queue", "SELECT match_id, count(*) AS scenes, CASE WHEN count(*) FILTER (NOT selected AND match_id % 3 = 0) > 0 THEN 'scene_disabled' END AS violation FROM moments_v WHERE selection_locked GROUP BY match_id")
def _(v):
    return G.render_queue(v.moments.withColumn("selected", F.expr("selected OR match_id % 3 <> 0")))
