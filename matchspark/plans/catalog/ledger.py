"""Queries over score samples, score changes and goal coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import ledger as L
from matchspark.plans.registry import query

DUR = 5_110_000
EXPECT = "SELECT match_id, 1 + match_id % 4 AS expected FROM sources_v WHERE match_id % 10 <> 9"


def expected(v):
    return v.sources.selectExpr("match_id", "CASE WHEN match_id % 10 <> 9 THEN 1 + match_id % 4 END AS expected")


EXP_SQL = "expected_v AS (SELECT match_id, CASE WHEN match_id % 10 <> 9 THEN 1 + match_id % 4 END AS expected FROM sources_v)"
LIVE = "NOT (is_replay OR story_phase = 'replay')"
READABLE = "(readable AND home BETWEEN 0 AND 20 AND away BETWEEN 0 AND 20 AND trim(home_label) <> '')"
CLOCK = "CASE WHEN clock = '' THEN NULL WHEN clock LIKE '%+%' THEN 45*60 + 2*60 + 30 ELSE CAST(split_part(clock, ':', 1) AS BIGINT) * 60 + CAST(split_part(clock, ':', 2) AS BIGINT) END"


@query("read_score_samples", f"""WITH s AS (SELECT * FROM score_samples_v WHERE NOT (match_id % 7 = 3 AND sample_id = 5)), e AS (SELECT match_id, sample_id FROM score_samples_v),
  bad AS (SELECT DISTINCT match_id FROM e ANTI JOIN s USING (match_id, sample_id))
  SELECT match_id, sample_id, t_ms, {READABLE} AS readable, CASE WHEN {READABLE} THEN home END AS home, CASE WHEN {READABLE} THEN away END AS away, clock FROM s ANTI JOIN bad USING (match_id)""")
def _(v):
    return L.read_score_samples(v.score_samples.where("NOT (match_id % 7 = 3 AND sample_id = 5)"), v.score_samples.select("match_id", "sample_id"))


LEDGER_SQL = f"""WITH RECURSIVE ok AS MATERIALIZED (SELECT match_id, t_ms AS t, home AS h, away AS a, {CLOCK} AS c, row_number() OVER (PARTITION BY match_id ORDER BY sample_id) AS rn
    FROM score_samples_v WHERE {READABLE} AND t_ms <= {DUR}),
 walk AS (
  SELECT match_id, 0::BIGINT AS rn, 0::BIGINT AS n, NULL::BIGINT AS h0, NULL::BIGINT AS a0, NULL::BIGINT AS pt, NULL::BIGINT AS ph, NULL::BIGINT AS pa, NULL::BIGINT AS pc,
    []::STRUCT(n BIGINT, side VARCHAR, status VARCHAR, b BIGINT, f BIGINT, h BIGINT, a BIGINT, s BIGINT, e BIGINT)[] AS anchors, []::STRUCT(s BIGINT, e BIGINT, why VARCHAR)[] AS gaps
  FROM (SELECT DISTINCT match_id FROM ok)
  UNION ALL
  SELECT match_id, rn, CASE WHEN skip THEN n ELSE n + 1 END, CASE WHEN n = 0 THEN h ELSE h0 END, CASE WHEN n = 0 THEN a ELSE a0 END,
    CASE WHEN skip THEN pt ELSE t END, CASE WHEN skip THEN ph ELSE h END, CASE WHEN skip THEN pa ELSE a END, CASE WHEN skip THEN pc ELSE c END,
    CASE WHEN skip OR pt IS NULL THEN anchors WHEN step = 1 THEN list_append(anchors, struct_pack(n := len(anchors) + 1, side := side, status := 'provisional', b := pt, f := t, h := h, a := a, s := greatest(0, pt - 20000), e := least({DUR}, t + 20000)))
      WHEN step = -1 AND hit IS NOT NULL THEN [CASE WHEN x.n = hit THEN struct_pack(n := x.n, side := x.side, status := 'reversed', b := x.b, f := x.f, h := x.h, a := x.a, s := x.s, e := least({DUR}, t + 10000)) ELSE x END FOR x IN anchors] ELSE anchors END,
    CASE WHEN skip OR pt IS NULL OR step IN (0, 1) OR (step = -1 AND hit IS NOT NULL) THEN gaps
      ELSE list_append(gaps, struct_pack(s := pt, e := t, why := CASE WHEN step = -1 THEN 'unmatched_score_reversal' ELSE 'multiple_or_inconsistent_score_change' END)) END
  FROM (SELECT *, list_max([x.n FOR x IN anchors IF x.status <> 'reversed' AND x.side = q.side AND x.h = ph AND x.a = pa]) AS hit FROM
    (SELECT w.* EXCLUDE (rn), o.rn, o.t, o.h, o.a, o.c, coalesce(o.c < w.pc - 2, false) AS skip, CASE WHEN o.h <> w.ph THEN 'home' ELSE 'away' END AS side,
      CASE WHEN o.h = ph AND o.a = pa THEN 0 WHEN (o.h - ph = 1 AND o.a = pa) OR (o.a - pa = 1 AND o.h = ph) THEN 1 WHEN (o.h - ph = -1 AND o.a = pa) OR (o.a - pa = -1 AND o.h = ph) THEN -1 ELSE 9 END AS step
     FROM walk w JOIN ok o ON o.match_id = w.match_id AND o.rn = w.rn + 1) q)),
 final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY rn DESC) = 1)"""


def ledger(v):
    read = v.score_samples.withColumn("readable", F.expr(READABLE))
    return L.score_ledger(read, DUR)


@query("score_ledger", LEDGER_SQL + """ SELECT match_id, 'score-incident-' || x.n AS anchor_id, x.side AS side, x.status AS status, x.b AS before_ms, x.f AS after_ms, x.s AS start_ms, x.e AS end_ms
  FROM (SELECT match_id, unnest(anchors) AS x FROM final)""")
def _(v):
    return L.ledger_anchors(ledger(v))


@query("score_ledger_unresolved", LEDGER_SQL + " SELECT match_id, x.s AS start_ms, x.e AS end_ms, x.why AS reason FROM (SELECT match_id, unnest(gaps) AS x FROM final)")
def _(v):
    return L.ledger_unresolved(ledger(v))


@query("score_ledger_summary", LEDGER_SQL + """ SELECT match_id, n AS readings, len(anchors) AS anchors, len(gaps) AS unresolved, n >= 3 AND h0 = 0 AND a0 = 0 AND len(gaps) = 0 AS complete, ph AS home, pa AS away FROM final""")
def _(v):
    return L.ledger_summary(ledger(v))


OWN_SQL = f"""aw AS (SELECT *, coalesce(lag(after_ms) OVER (PARTITION BY match_id ORDER BY after_ms, anchor_id), -1) AS prev_ms FROM anchors_v),
 mc AS (SELECT *, coalesce(CASE WHEN proof_verified AND proof_start_ms BETWEEN start_ms AND end_ms THEN proof_start_ms END,
   CASE WHEN semantic_verified AND payoff_start_ms BETWEEN start_ms AND end_ms THEN payoff_start_ms END, CASE WHEN contact_ms BETWEEN start_ms AND end_ms THEN contact_ms END) AS clock_ms FROM moments_v),
 mt AS (SELECT m.match_id, m.moment_id, min(anchor_id) AS anchor_id, min(status) AS anchor_status FROM mc m JOIN aw a ON a.match_id = m.match_id
   AND CASE WHEN clock_ms IS NOT NULL THEN clock_ms >= greatest(search_start_ms, prev_ms) AND (prev_ms = -1 OR clock_ms > prev_ms + 1) AND clock_ms <= after_ms + 1
       ELSE start_ms >= greatest(search_start_ms, prev_ms) AND end_ms <= after_ms + 1 END
   WHERE {LIVE} GROUP BY m.match_id, m.moment_id HAVING count(*) = 1)"""


@query("anchor_for_scene", f"WITH {OWN_SQL} SELECT match_id, moment_id, anchor_id FROM moments_v LEFT JOIN mt USING (match_id, moment_id)")
def _(v):
    return L.anchor_for_scene(v.moments, v.anchors).select("match_id", "moment_id", "anchor_id")


COVER_SQL = f"""cov AS (SELECT a.match_id, a.anchor_id, CASE WHEN a.status = 'reversed' THEN 'disallowed_goal' ELSE 'goal' END AS required_type, a.status <> 'reversed' AS required,
   coalesce(bool_or(m.event_type = CASE WHEN a.status = 'reversed' THEN 'disallowed_goal' ELSE 'goal' END), false) AS covered, count(m.moment_id) AS scenes
  FROM anchors_v a LEFT JOIN (SELECT m.*, mt.anchor_id FROM moments_v m JOIN mt USING (match_id, moment_id) WHERE semantic_verified AND action_complete AND keep_decision <> 'reject'
     AND event_type IN ('goal', 'disallowed_goal') AND {LIVE}) m ON m.match_id = a.match_id AND m.anchor_id = a.anchor_id GROUP BY ALL)"""


@query("score_coverage", f"WITH {OWN_SQL}, {COVER_SQL} SELECT * FROM cov")
def _(v):
    return L.score_coverage(v.moments, v.anchors)


SAMPLES = ["match_id", "ordinal", "start_ms AS t_ms", "CASE WHEN ordinal % 13 <> 5 THEN CAST(floor(start_ms / 1000) AS BIGINT) END AS clock_s", "CAST(floor(start_ms / 400000) AS BIGINT) AS home", "ordinal % 2 AS away"]


@query("stable_score", f"""WITH s AS (SELECT {', '.join(SAMPLES)} FROM moments_v), m AS (SELECT *, CASE WHEN contact_ms > start_ms THEN least(start_ms + 1000, contact_ms - 250) ELSE start_ms END AS setup_ms FROM moments_v WHERE {LIVE}),
  b AS (SELECT m.match_id, m.moment_id, m.start_ms, m.end_ms, max(struct_pack(t := t_ms, o := s.ordinal)) AS before FROM m JOIN s ON s.match_id = m.match_id AND t_ms <= setup_ms GROUP BY ALL),
  c AS (SELECT b.*, min(struct_pack(t := t_ms, o := s.ordinal)) AS after FROM b JOIN s ON s.match_id = b.match_id AND t_ms >= b.end_ms GROUP BY ALL)
  SELECT c.match_id, moment_id, x.t_ms AS before_ms, y.t_ms AS after_ms FROM c JOIN s x ON x.match_id = c.match_id AND x.t_ms = before.t AND x.ordinal = before.o JOIN s y ON y.match_id = c.match_id AND y.t_ms = after.t AND y.ordinal = after.o
  WHERE start_ms - x.t_ms <= 25000 AND y.t_ms - end_ms <= 25000 AND y.clock_s > x.clock_s AND x.home = y.home AND x.away = y.away""")
def _(v):
    return L.stable_score(v.moments, v.moments.selectExpr(*SAMPLES))


GOALS_SQL = """gl AS (SELECT * FROM moments_v WHERE selection_locked IS NOT TRUE AND event_type = 'goal' AND semantic_verified AND action_complete AND keep_decision <> 'reject'
    AND NOT (is_replay OR story_phase = 'replay') AND proof_verified AND proof_start_ms BETWEEN start_ms AND end_ms),
 gg AS (SELECT *, CASE WHEN coalesce(max(end_ms) OVER (PARTITION BY match_id ORDER BY start_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - start_ms > 100 THEN 0 ELSE 1 END AS op FROM gl),
 gi AS (SELECT *, CAST(sum(op) OVER (PARTITION BY match_id ORDER BY start_ms, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM gg)"""


@query("overlap_groups", f"WITH {GOALS_SQL} SELECT match_id, moment_id, island FROM gi")
def _(v):
    goals = v.moments.where("""selection_locked IS NOT TRUE AND event_type = 'goal' AND semantic_verified AND action_complete AND keep_decision <> 'reject'
      AND NOT (is_replay OR story_phase = 'replay') AND proof_verified AND proof_start_ms BETWEEN start_ms AND end_ms""")
    return L.overlap_groups(goals.select("match_id", "moment_id", "ordinal", "start_ms", "end_ms")).select("match_id", "moment_id", "island")


# anchors taken from the proven goals themselves, so that counts can agree
PAIR = ["match_id", "concat('a', CAST(ordinal AS STRING)) AS anchor_id", "CASE WHEN match_id % 11 = 3 THEN 'reversed' ELSE 'provisional' END AS status", "end_ms + 500 AS after_ms",
        "start_ms - 20000 AS search_start_ms", "end_ms + CASE WHEN match_id % 5 = 2 THEN -19000 ELSE 20000 END AS search_end_ms"]
PAIR_WHERE = """event_type = 'goal' AND semantic_verified AND action_complete AND keep_decision <> 'reject' AND NOT (is_replay OR story_phase = 'replay') AND proof_verified
   AND proof_start_ms BETWEEN start_ms AND end_ms AND selection_locked IS NOT TRUE AND NOT (match_id % 6 = 1 AND ordinal % 3 = 0)"""


@query("own_goals", f"""WITH {GOALS_SQL}, an AS (SELECT {', '.join(PAIR)} FROM moments_v WHERE {PAIR_WHERE}), ao AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY after_ms, anchor_id) AS island FROM an),
  ev AS (SELECT match_id FROM (SELECT match_id, count(*) AS na, bool_or(status = 'reversed') AS u FROM an GROUP BY match_id) JOIN (SELECT match_id, max(island) AS ng FROM gi GROUP BY match_id) USING (match_id) WHERE na = ng AND NOT u AND match_id % 4 <> 3),
  p AS (SELECT gi.match_id, moment_id, anchor_id, gi.island, proof_start_ms BETWEEN search_start_ms AND search_end_ms AS fits FROM gi JOIN ev USING (match_id) JOIN ao ON ao.match_id = gi.match_id AND ao.island = gi.island)
  SELECT match_id, moment_id, anchor_id, island FROM p WHERE match_id NOT IN (SELECT match_id FROM p WHERE NOT fits)""")
def _(v):
    return L.own_goals(v.moments, v.moments.where(PAIR_WHERE).selectExpr(*PAIR), v.sources.where("match_id % 4 <> 3").select("match_id"))


@query("rebind_story", f"""WITH {OWN_SQL}, lv AS (SELECT m.*, mt.anchor_id, mt.anchor_status FROM moments_v m JOIN mt USING (match_id, moment_id) WHERE event_type IN ('goal', 'disallowed_goal') AND {LIVE}),
  ob AS (SELECT * FROM lv WHERE semantic_verified AND action_complete AND keep_decision <> 'reject'),
  fo AS (SELECT f.match_id, f.moment_id, arg_max(struct_pack(a := o.anchor_id, s := o.anchor_status, g := o.moment_id), struct_pack(s := o.start_ms, o := o.ordinal)) AS g
    FROM moments_v f JOIN ob o ON o.match_id = f.match_id AND f.start_ms >= o.end_ms - CASE WHEN f.event_type = 'celebration' OR f.story_phase = 'reaction' THEN 500 ELSE 100 END AND f.start_ms - o.end_ms <= 12000
    WHERE f.is_replay OR f.story_phase = 'replay' OR f.event_type = 'celebration' OR f.story_phase = 'reaction' GROUP BY ALL)
  SELECT m.match_id, m.moment_id, coalesce(fo.g.a, lv.anchor_id, m.story_id) AS story_id, fo.g.g AS goal_id,
    CASE WHEN m.event_type IN ('goal', 'disallowed_goal') AND coalesce(fo.g.s, lv.anchor_status) = 'reversed' THEN 'disallowed_goal' ELSE m.event_type END AS event_type
  FROM moments_v m LEFT JOIN lv USING (match_id, moment_id) LEFT JOIN fo USING (match_id, moment_id)""")
def _(v):
    return L.rebind_story(v.moments, v.anchors).select("match_id", "moment_id", "story_id", "goal_id", "event_type")


COUNT_SQL = f"""cnt AS (SELECT match_id, count(DISTINCT story_id) AS observed FROM moments_v WHERE event_type = 'goal' AND keep_decision <> 'reject'
    AND ({LIVE} OR (angle_selected AND score_observation)) AND semantic_verified AND action_complete AND NOT angle_deferred AND NOT support_deferred AND crosscheck_verified IS NOT FALSE GROUP BY match_id),
  gc AS (SELECT match_id, expected, coalesce(observed, 0) AS observed, coalesce(greatest(0, expected - coalesce(observed, 0)), 0) AS missing, coalesce(greatest(0, coalesce(observed, 0) - expected), 0) AS excess,
    coalesce(expected = coalesce(observed, 0), true) AS complete FROM expected_v LEFT JOIN cnt USING (match_id))"""


@query("goal_story_count", f"WITH {EXP_SQL}, {COUNT_SQL} SELECT * FROM gc")
def _(v):
    return L.goal_story_count(v.moments, expected(v))


@query("drop_unproved_goals", f"""WITH {EXP_SQL}, ex AS (SELECT * FROM moments_v WHERE ordinal % 2 = 0), kn AS (SELECT DISTINCT match_id, story_id FROM ex WHERE event_type = 'goal' AND keep_decision <> 'reject' AND semantic_verified AND {LIVE})
  SELECT r.match_id, r.moment_id FROM moments_v r JOIN expected_v e USING (match_id) WHERE ordinal % 2 = 1 AND (expected IS NULL OR (SELECT count(*) FROM kn WHERE kn.match_id = r.match_id) < expected
     OR event_type <> 'goal' OR EXISTS (SELECT 1 FROM kn WHERE kn.match_id = r.match_id AND kn.story_id = r.story_id))""")
def _(v):
    out = L.drop_unproved_goals(v.moments.where("ordinal % 2 = 0"), v.moments.where("ordinal % 2 = 1"), expected(v))
    return out.select("match_id", "moment_id")


@query("live_goal_found", f"""SELECT a.match_id, a.anchor_id, EXISTS (SELECT 1 FROM (SELECT *, CASE WHEN proof_verified THEN proof_start_ms ELSE coalesce(contact_ms, end_ms) END AS f FROM moments_v) m
   WHERE m.match_id = a.match_id AND event_type IN ('goal', 'disallowed_goal') AND action_complete AND {LIVE} AND keep_decision <> 'reject' AND f BETWEEN start_ms AND end_ms AND f <= a.after_ms + 1) AS found FROM anchors_v a""")
def _(v):
    return L.live_goal_found(v.moments, v.anchors)


@query("recovery_needed", f"""WITH {EXP_SQL}, {OWN_SQL}, {COVER_SQL}, {COUNT_SQL}, cs AS (SELECT match_id, bool_or(required) AS any_live, count(*) FILTER (required AND NOT covered) AS unc FROM cov GROUP BY match_id)
  SELECT gc.match_id, coalesce(any_live AND unc = 0 AND complete, false) AS duration_only, CAST(least(4, greatest(1, ceil(greatest(0, gc.match_id * 700 - 20000) / 15000))) AS BIGINT) AS windows, gc.match_id * 700 - 20000 > 50 AS revisit_all
  FROM gc LEFT JOIN cs USING (match_id)""")
def _(v):
    return L.recovery_needed(v.moments, v.anchors, expected(v), v.sources.selectExpr("match_id", "match_id * 700 - 20000 AS missing_ms"))


DEC_SQL = ", ".join(f"'{d}'" for d in L.VERIFIED_DECISIONS)


@query("incident_coverage", f"""WITH n AS (SELECT match_id, story_id AS story, count(*) AS candidates, bool_or(event_type = 'goal') AS g, bool_or(event_type = 'disallowed_goal') AS d FROM moments_v
    WHERE semantic_verified AND event_type IN ('goal', 'var', 'offside', 'disallowed_goal') GROUP BY ALL),
  s AS (SELECT *, tracking_decision IN ({DEC_SQL}) AS shown FROM moments_v WHERE semantic_verified AND keep_decision <> 'reject' AND selected)
  SELECT match_id, story, CASE WHEN g THEN 'goal' WHEN d THEN 'disallowed_goal' ELSE 'decision' END AS kind, candidates, EXISTS (SELECT 1 FROM s WHERE s.match_id = n.match_id AND s.story_id = n.story AND shown AND
    CASE WHEN g THEN event_type = 'goal' AND action_complete IS TRUE AND ({LIVE} OR angle_selected) WHEN d THEN event_type = 'disallowed_goal' AND action_complete IS TRUE
      ELSE event_type IN ('offside', 'var') AND action_complete IS NOT FALSE AND tracking_passed IS NOT FALSE END) AS covered FROM n""")
def _(v):
    return L.incident_coverage(v.moments)
