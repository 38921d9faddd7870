"""Queries over stories: incidents, replay links, views, reels and treatments."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import reels as R
from matchspark.operators import stories as S
from matchspark.operators.ledger import VERIFIED_DECISIONS
from matchspark.plans.catalog.linking import UNIQUE_SQL
from matchspark.plans.registry import query

REACT = "(event_type = 'celebration' OR coalesce(story_phase = 'reaction', false))"
REPLAY = "(is_replay OR coalesce(story_phase = 'replay', false))"
SOUND = "(semantic_verified IS TRUE AND action_complete IS TRUE AND keep_decision <> 'reject')"
#: The moments of a match moved together, so that clips of one match meet; stories lie far apart.
CLOSE = ["start_ms", "end_ms", "contact_ms"]
CLOSE_STORY = "concat('s', CAST((ordinal * 7) % 60 AS STRING))"
SHIFT = "CAST(floor(start_ms / 16) AS BIGINT) - start_ms"
CLOSE_SQL = f"d AS (SELECT *, {SHIFT} AS move FROM moments_v), m AS (SELECT * EXCLUDE (move) REPLACE ({', '.join(f'{c} + move AS {c}' for c in CLOSE)}, {CLOSE_STORY} AS story_id) FROM d)"


def close(v):
    moved = v.moments.withColumn("move", F.expr(SHIFT))
    return moved.withColumns({c: F.col(c) + F.col("move") for c in CLOSE}).withColumn("story_id", F.expr(CLOSE_STORY)).drop("move")


OBS = ["match_id", "moment_id", "ordinal", "story_id", "event_type", "start_ms", "end_ms", "contact_ms", f"{REPLAY} AS is_replay"]
OBS_WHERE = "event_type IN ('goal', 'disallowed_goal') AND story_phase <> 'reaction'"
CONTACT = lambda a, b: f"({a}.event_type = {b}.event_type AND coalesce(abs({a}.contact_ms - {b}.contact_ms) < 1000, false) AND least({a}.end_ms, {b}.end_ms) > greatest({a}.start_ms, {b}.start_ms))"
LISTED = "list(struct_pack(moment_id, event_type, story_id, start_ms, end_ms, contact_ms, is_replay) ORDER BY start_ms, ordinal)"
INCIDENT_SQL = f"""{CLOSE_SQL}, o AS (SELECT {', '.join(OBS)} FROM m WHERE {OBS_WHERE}), a AS (SELECT match_id, {LISTED} AS r FROM o GROUP BY match_id),
  w AS (SELECT match_id, r, 1 AS i, [1] AS g FROM a UNION ALL SELECT match_id, r, i + 1, list_append(g, coalesce(
    list_min([g[j] FOR j IN range(1, i + 1) IF (r[j].event_type = r[i + 1].event_type AND r[j].story_id = r[i + 1].story_id) OR {CONTACT('r[j]', 'r[i + 1]')}]),
    CASE WHEN r[i + 1].is_replay THEN list_max([g[j] FOR j IN range(1, i + 1) IF r[j].event_type = r[i + 1].event_type AND r[i + 1].start_ms - r[j].end_ms BETWEEN 0 AND 45000]) END, i + 1)) FROM w WHERE i < len(r)),
  x AS (SELECT match_id, r, g, unnest(range(1, len(r) + 1)) AS i FROM w WHERE i = len(r)), v AS (SELECT match_id, i, r[i] AS o, g[i] AS g, r[g[i]] AS f FROM x)"""


def observed(v):
    return close(v).where(OBS_WHERE).selectExpr(*OBS)


@query("scoring_incidents", f"WITH RECURSIVE {INCIDENT_SQL} SELECT match_id, o.moment_id AS moment_id, f.moment_id AS incident_id FROM v")
def _(v):
    return S.scoring_incidents(observed(v)).select("match_id", "moment_id", "incident_id")


FIX = "CASE WHEN event_type IN ('save', 'shot_on_target', 'shot_off_target') AND ordinal % 3 = 0 THEN 'goal' WHEN event_type IN ('save', 'big_chance') AND ordinal % 3 = 1 THEN 'disallowed_goal' END"


@query("scoring_coverage", f"""WITH RECURSIVE {INCIDENT_SQL}, e AS (SELECT * FROM m WHERE selected AND {SOUND} AND NOT angle_deferred AND NOT support_deferred AND event_type IN ('goal', 'disallowed_goal')),
  c AS (SELECT *, {FIX} AS corrected_from FROM m WHERE {SOUND}),
  k AS (SELECT match_id, f.moment_id AS incident_id, any_value(f.story_id) AS story_id, any_value(f.event_type) AS event_type, count(*) AS observations,
    bool_or(EXISTS (SELECT 1 FROM e WHERE e.match_id = v.match_id AND e.event_type = o.event_type AND (e.story_id = o.story_id OR (coalesce(abs(e.contact_ms - o.contact_ms) < 1000, false) AND least(e.end_ms, o.end_ms) > greatest(e.start_ms, o.start_ms))))) AS retained,
    list_min(flatten(list((SELECT list(struct_pack(o := c.ordinal, t := c.event_type)) FROM c WHERE c.match_id = v.match_id AND c.story_id = v.o.story_id AND c.corrected_from = v.o.event_type)))) AS fix FROM v GROUP BY match_id, f.moment_id)
  SELECT match_id, incident_id, story_id, event_type, observations, retained OR fix IS NOT NULL AS covered, CASE WHEN retained THEN 'retained_scoring_action' WHEN fix IS NOT NULL THEN 'source_outcome_corrected' END AS resolution, fix.t AS corrected_event_type FROM k""")
def _(v):
    m = close(v)
    return S.scoring_coverage(observed(v), m.where("selected"), m.withColumn("corrected_from", F.expr(FIX)))


PROVEN = "(semantic_verified IS TRUE AND (keep_decision <> 'reject' OR coalesce(tracking_decision = 'phase_verified_goal', false)))"
DOUBT = f"(NOT {REPLAY} AND (keep_decision = 'reject' OR semantic_verified IS FALSE OR coalesce(tracking_decision = 'incomplete_goal_action', false)))"
MEETS = "r[j].start_ms <= r[i + 1].start_ms AND (r[i + 1].start_ms - r[j].end_ms BETWEEN 0 AND CASE WHEN r[i + 1].again THEN 45000 ELSE 8000 END OR (r[i + 1].start_ms > r[j].start_ms AND least(r[i + 1].end_ms, r[j].end_ms) > greatest(r[i + 1].start_ms, r[j].start_ms)))"
LINK_SQL = f"""{CLOSE_SQL}, lv AS (SELECT DISTINCT match_id, story_id FROM m WHERE event_type = 'goal' AND NOT {REPLAY} AND {PROVEN}),
  gs AS (SELECT m.*, {REPLAY} AS again, {REPLAY} AND lv.story_id IS NULL AS only_replays, {DOUBT} AS doubt, NOT is_replay AND {PROVEN} AS stands FROM m LEFT JOIN lv ON lv.match_id = m.match_id AND lv.story_id = m.story_id WHERE event_type = 'goal'),
  ga AS (SELECT match_id, list(struct_pack(moment_id, story_id, start_ms, end_ms, again, only_replays, doubt, stands) ORDER BY start_ms, ordinal) AS r FROM gs GROUP BY match_id),
  gw AS (SELECT match_id, r, 0 AS i, CAST([] AS BIGINT[]) AS live, CAST([] AS BIGINT[]) AS to_goal FROM ga
    UNION ALL SELECT match_id, r, i + 1, CASE WHEN NOT hit AND r[i + 1].stands THEN list_append(live, i + 1) ELSE live END, list_append(to_goal, CASE WHEN hit THEN p END) FROM
      (SELECT *, coalesce(r[p].story_id <> r[i + 1].story_id AND (r[i + 1].doubt OR (r[i + 1].again AND (r[i + 1].only_replays OR r[i + 1].start_ms - r[p].end_ms <= 12000))), false) AS hit FROM
        (SELECT *, list_max([j FOR j IN live IF {MEETS}]) AS p FROM gw WHERE i < len(r)))),
  gx AS (SELECT match_id, r, to_goal, unnest(range(1, len(r) + 1)) AS i FROM gw WHERE i = len(r)),
  lk AS (SELECT match_id, r[i].moment_id AS moment_id, i, r[i].story_id AS own, r[i].only_replays AS only_replays, r[to_goal[i]].story_id AS to_story, r[to_goal[i]].moment_id AS linked_id FROM gx WHERE to_goal[i] IS NOT NULL),
  mv AS (SELECT match_id, own, arg_max(to_story, i) AS target FROM lk WHERE only_replays GROUP BY ALL),
  l1 AS (SELECT m.* REPLACE (coalesce(lk.to_story, m.story_id) AS story_id, lk.linked_id IS NOT NULL OR m.is_replay AS is_replay, CASE WHEN lk.linked_id IS NOT NULL THEN 'replay' ELSE m.story_phase END AS story_phase), lk.linked_id FROM m LEFT JOIN lk ON lk.match_id = m.match_id AND lk.moment_id = m.moment_id),
  l2 AS (SELECT l1.* REPLACE (CASE WHEN target IS NOT NULL AND ({REPLAY} OR {REACT}) THEN target ELSE story_id END AS story_id) FROM l1 LEFT JOIN mv ON mv.match_id = l1.match_id AND mv.own = l1.story_id)"""


@query("link_replays", f"WITH RECURSIVE {LINK_SQL} SELECT match_id, moment_id, story_id, is_replay, story_phase, linked_id FROM l2")
def _(v):
    return S.link_replays(close(v)).select("match_id", "moment_id", "story_id", "is_replay", "story_phase", "linked_id")


VIEWED = {"readability": "CAST((ordinal * 3) % 10 AS DOUBLE)", "evidence_version": "CASE WHEN ordinal % 11 = 4 THEN 1 ELSE 2 END"}
AFTER = "x.start_ms BETWEEN g.end_ms - 100 AND g.end_ms + 1000"


@query("incident_views", f"""WITH RECURSIVE {LINK_SQL}, e AS (SELECT *, {VIEWED['readability']} AS readability, {REPLAY} AS again FROM l2 WHERE {SOUND} AND {VIEWED['evidence_version']} = 2),
  va AS (SELECT match_id, list(struct_pack(moment_id, event_type, story_id, start_ms, end_ms, contact_ms) ORDER BY start_ms, ordinal) AS r FROM e WHERE NOT {REACT} GROUP BY match_id),
  vw AS (SELECT match_id, r, 1 AS i, [1] AS g FROM va UNION ALL SELECT match_id, r, i + 1, list_append(g, coalesce(list_min([g[j] FOR j IN range(1, i + 1) IF {CONTACT('r[j]', 'r[i + 1]')}]),
    list_min([g[j] FOR j IN range(1, i + 1) IF r[g[j]].story_id = r[i + 1].story_id]), i + 1)) FROM vw WHERE i < len(r)),
  vx AS (SELECT match_id, r, g, unnest(range(1, len(r) + 1)) AS i FROM vw WHERE i = len(r)), vg AS (SELECT match_id, r[i].moment_id AS moment_id, g[i] AS grp FROM vx),
  vr AS (SELECT e.*, grp, row_number() OVER (PARTITION BY e.match_id, grp ORDER BY readability DESC, visual_clarity DESC, completeness DESC, again, start_ms, ordinal) AS n FROM e JOIN vg ON vg.match_id = e.match_id AND vg.moment_id = e.moment_id),
  vp AS (SELECT match_id, grp, story_id AS to_story FROM vr WHERE n = 1), rx AS (SELECT * FROM e WHERE {REACT}),
  fo AS (SELECT match_id, moment_id, story_id, event_type, start_ms, end_ms, ordinal FROM vr WHERE n = 1 AND event_type = 'goal'
    UNION SELECT x.match_id, x.moment_id, x.story_id, x.event_type, x.start_ms, x.end_ms, x.ordinal FROM fo g JOIN rx x ON x.match_id = g.match_id AND x.story_id = g.story_id AND g.event_type = 'goal' AND {AFTER}),
  fr AS (SELECT * FROM fo WHERE moment_id IN (SELECT moment_id FROM rx)), ce AS (SELECT match_id, story_id, min(struct_pack(a := start_ms, b := ordinal)) AS until FROM fr WHERE event_type = 'celebration' GROUP BY ALL),
  ch AS (SELECT match_id, moment_id FROM vr WHERE n = 1 UNION SELECT fr.match_id, moment_id FROM fr LEFT JOIN ce ON ce.match_id = fr.match_id AND ce.story_id = fr.story_id WHERE until IS NULL OR struct_pack(a := start_ms, b := ordinal) <= until)
  SELECT l2.match_id, l2.moment_id, coalesce(vp.to_story, l2.story_id) AS story_id, ch.moment_id IS NOT NULL AS angle_selected, ch.moment_id IS NOT NULL AND l2.event_type IN ('goal', 'disallowed_goal') AS chosen_incident_angle
  FROM l2 LEFT JOIN vr ON vr.match_id = l2.match_id AND vr.moment_id = l2.moment_id LEFT JOIN vp ON vp.match_id = vr.match_id AND vp.grp = vr.grp LEFT JOIN ch ON ch.match_id = l2.match_id AND ch.moment_id = l2.moment_id""")
def _(v):
    return S.incident_views(close(v).withColumns({k: F.expr(e) for k, e in VIEWED.items()}))


MORE = "ordinal % 2 = 1"
EXTRA = f"{MORE} AND angle_selected AND {SOUND} AND event_type IN ({', '.join(repr(x) for x in R.EXTRA_EVENTS)}) AND CASE WHEN visual_clarity <> 0 THEN visual_clarity ELSE importance END >= 55"


@query("extra_actions", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE event_type WHEN 'save' THEN 5 WHEN 'shot_on_target' THEN 5 WHEN 'big_chance' THEN 4 WHEN 'tackle' THEN 3 WHEN 'shot_off_target' THEN 2 ELSE 0 END DESC,
    visual_clarity DESC, importance DESC, start_ms, ordinal) AS rank FROM moments_v WHERE {EXTRA}),
  b AS (SELECT match_id, 0 AS rank, start_ms AS s, end_ms AS e FROM moments_v WHERE NOT ({MORE}) AND semantic_verified IS TRUE AND keep_decision <> 'reject' AND NOT angle_deferred AND NOT support_deferred UNION ALL SELECT match_id, rank, start_ms, end_ms FROM x),
  p AS (SELECT x.match_id, x.moment_id, x.rank, b.s, b.e FROM x LEFT JOIN b ON b.match_id = x.match_id AND b.rank < x.rank),
  m AS (SELECT *, max(e) OVER (PARTITION BY match_id, rank ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
  c AS (SELECT match_id, moment_id, rank, coalesce(sum(greatest(0, e - greatest(s, coalesce(reach, s)))), 0) AS covered FROM m GROUP BY ALL)
  SELECT a.match_id, a.moment_id, coalesce(rank <= 1 OR covered < 180000, false) AS extra_selected, NOT coalesce(rank <= 1 OR covered < 180000, false) AS angle_deferred
  FROM moments_v a LEFT JOIN c ON c.match_id = a.match_id AND c.moment_id = a.moment_id WHERE {MORE}""")
def _(v):
    return R.extra_actions(v.moments.withColumn("additional_action", F.expr(MORE)), 1, 180_000)


COMPRESSED = "ordinal % 17 = 3"
RATE = "least(1.18e0, greatest(0.72e0, playback_rate))"
SHOWN = lambda rate: f"least(30000e0, d / {rate})"
WHOLE = lambda want: f"least(1.18e0, greatest(0.72e0, {want}, d / 30000))"


@query("expand_timeline", f"""WITH RECURSIVE t AS (SELECT *, CAST(end_ms - start_ms AS DOUBLE) AS d, {RATE} AS rate, {REACT} AS react, {REPLAY} AS again, effect = 'freeze_analysis' AS frozen, row_number() OVER (PARTITION BY match_id ORDER BY ordinal) AS pos FROM moments_v WHERE selected),
  u AS (SELECT *, NOT react AND NOT again AND event_type IN ({', '.join(repr(x) for x in R.ANALYSED)}) AND NOT {COMPRESSED} AS live, CASE WHEN frozen THEN least(1000, greatest(800, freeze_ms)) ELSE 800 END AS held,
    CASE WHEN frozen THEN CAST(least(1000, greatest(400, CASE WHEN freeze_ms = 0 THEN 650 ELSE freeze_ms END)) AS DOUBLE) ELSE 0e0 END AS now, CASE WHEN pos = 1 THEN 0 ELSE least(360, greatest(40, transition_ms)) END AS cost FROM t),
  r AS (SELECT *, CASE WHEN live THEN least(rate, {WHOLE('0.82e0')}) ELSE rate END AS r1, least(rate, {WHOLE('0.84e0')}) AS r4 FROM u), q AS (SELECT *, CASE WHEN NOT react THEN least(r1, {WHOLE('0.72e0')}) ELSE r1 END AS r3 FROM r),
  g AS (SELECT match_id, moment_id, 1 AS stage, 0 AS late, -importance AS back, ordinal, {SHOWN('r1')} - {SHOWN('rate')} AS gain FROM q WHERE live UNION ALL SELECT match_id, moment_id, 2, 0, -importance, ordinal, held - now FROM q WHERE live
    UNION ALL SELECT match_id, moment_id, 3, CASE WHEN is_replay THEN 1 ELSE 0 END, -importance, ordinal, {SHOWN('r3')} - {SHOWN('r1')} FROM q WHERE NOT react UNION ALL SELECT match_id, moment_id, 4, 0, 0, ordinal, {SHOWN('r4')} - {SHOWN('rate')} FROM q WHERE react),
  s AS (SELECT match_id, list(struct_pack(moment_id, stage, gain) ORDER BY stage, late, back, ordinal) AS l FROM g GROUP BY match_id), b AS (SELECT match_id, sum({SHOWN('rate')} + now - cost) AS total FROM q GROUP BY match_id),
  w AS (SELECT s.match_id, l, 0 AS i, total, CAST([] AS INTEGER[]) AS took FROM s JOIN b USING (match_id) UNION ALL
    SELECT match_id, l, i + 1, CASE WHEN ok THEN total + l[i + 1].gain ELSE total END, CASE WHEN ok THEN list_append(took, i + 1) ELSE took END FROM (SELECT *, total < 499250 AND (l[i + 1].stage < 4 OR (l[i + 1].gain > 0 AND total + l[i + 1].gain <= 503000)) AS ok FROM w WHERE i < len(l))),
  k AS (SELECT match_id, l[j].moment_id AS moment_id, l[j].stage AS stage FROM (SELECT match_id, l, unnest(took) AS j FROM w WHERE i = len(l))), h AS (SELECT match_id, moment_id, bool_or(stage = 1) AS t1, bool_or(stage = 2) AS t2, bool_or(stage = 3) AS t3, bool_or(stage = 4) AS t4 FROM k GROUP BY ALL)
  SELECT q.match_id, q.moment_id, row_number() OVER (PARTITION BY q.match_id ORDER BY edit_order IS NULL, edit_order, start_ms, ordinal) - 1 AS edit_order,
    CASE WHEN t4 THEN r4 WHEN t3 AND r3 < CASE WHEN t1 THEN r1 ELSE rate END THEN r3 WHEN t1 AND r1 < rate THEN r1 ELSE playback_rate END AS playback_rate, CASE WHEN t2 THEN 'freeze_analysis' ELSE effect END AS effect, CASE WHEN t2 THEN held ELSE freeze_ms END AS freeze_ms
  FROM q LEFT JOIN h ON h.match_id = q.match_id AND h.moment_id = q.moment_id""")
def _(v):
    return R.expand_timeline(v.moments.withColumn("compressed", F.expr(COMPRESSED)), 500_000)


HOOK = "CAST((ordinal * 17) % 101 AS DOUBLE)"
LEADS = f"event_type IN ({', '.join(repr(x) for x in R.REEL_WEIGHT)})"


@query("reel_plan", f"""WITH RECURSIVE a AS (SELECT match_id, story_id AS story, moment_id, ordinal, start_ms, end_ms, event_type, story_phase, visual_clarity, {REPLAY} AS again, {REACT} AS react, event_type IN ('var', 'offside', 'disallowed_goal') AS decides, (end_ms - start_ms) / {RATE} AS own_len,
    round(CASE event_type WHEN 'goal' THEN 42 WHEN 'disallowed_goal' THEN 40 WHEN 'save' THEN 30 WHEN 'shot_on_target' THEN 24 WHEN 'big_chance' THEN 20 ELSE 0 END + importance * 0.2e0 + {HOOK} * 0.12e0 + completeness * 0.16e0 + visual_clarity * 0.12e0, 6) AS worth
    FROM moments_v WHERE semantic_verified IS TRUE AND keep_decision <> 'reject' AND coalesce(tracking_decision, '') NOT IN ({', '.join(repr(x) for x in R.NOT_SHOWN)})),
  ac AS (SELECT * FROM a WHERE {LEADS} AND NOT again QUALIFY row_number() OVER (PARTITION BY match_id, story ORDER BY worth DESC, ordinal) = 1),
  co AS (SELECT match_id, story, least(12, 6 * count(*) FILTER (again)) + least(8, 4 * count(*) FILTER (react)) + least(10, 5 * count(*) FILTER (decides)) AS company, bool_or(decides) AS decision FROM a GROUP BY ALL),
  st AS (SELECT ac.match_id, ac.story, worth + company AS score, decision, ac.moment_id AS action, ac.start_ms AS action_start FROM ac JOIN co USING (match_id, story)),
  rp AS (SELECT * FROM a WHERE again QUALIFY row_number() OVER (PARTITION BY match_id, story ORDER BY visual_clarity DESC, start_ms, ordinal) = 1),
  re AS (SELECT *, row_number() OVER (PARTITION BY match_id, story ORDER BY start_ms, ordinal) AS n FROM a WHERE react QUALIFY n <= 2), de AS (SELECT *, row_number() OVER (PARTITION BY match_id, story ORDER BY start_ms, ordinal) AS n FROM a WHERE NOT react AND event_type IN ('var', 'offside') QUALIFY n <= 2),
  bu AS (SELECT a.* FROM a JOIN st USING (match_id, story) WHERE a.moment_id <> action AND story_phase = 'build_up' AND end_ms <= action_start + 250 QUALIFY row_number() OVER (PARTITION BY match_id, story ORDER BY end_ms DESC, a.ordinal) = 1),
  sq AS (SELECT match_id, story, moment_id, 'build_up' AS role, 0 AS place, end_ms, (end_ms - start_ms) / 1e0 AS len FROM bu WHERE own_len >= 4000 UNION ALL SELECT match_id, story, moment_id, 'action', 10, end_ms, (end_ms - start_ms) / 0.72e0 + 900 FROM ac
    UNION ALL SELECT re.match_id, re.story, re.moment_id, 'reaction', CASE WHEN rp.start_ms IS NULL OR re.start_ms < rp.start_ms THEN 20 ELSE 50 END + n, least(re.end_ms, re.start_ms + 7000), least(re.end_ms - re.start_ms, 7000) / 1e0 FROM re LEFT JOIN rp ON rp.match_id = re.match_id AND rp.story = re.story
    UNION ALL SELECT rp.match_id, rp.story, rp.moment_id, 'replay', 30, rp.end_ms, (rp.end_ms - rp.start_ms) / 0.82e0 + CASE WHEN decision THEN 720 ELSE 0 END FROM rp JOIN co USING (match_id, story) UNION ALL SELECT match_id, story, moment_id, 'decision', 40 + n, end_ms, (end_ms - start_ms) / 1e0 FROM de),
  e AS (SELECT sq.* REPLACE (round(len, 3) AS len), score, action_start FROM sq JOIN st USING (match_id, story) QUALIFY row_number() OVER (PARTITION BY match_id, sq.story, moment_id ORDER BY place) = 1),
  l AS (SELECT match_id, list(struct_pack(story, moment_id, len) ORDER BY score DESC, action_start, story, place) AS l FROM e GROUP BY match_id),
  w AS (SELECT match_id, l, 0 AS i, 0e0 AS total, '' AS story, false AS fin, CAST([] AS INTEGER[]) AS took FROM l UNION ALL
    SELECT match_id, l, i + 1, CASE WHEN ok THEN total + l[i + 1].len ELSE total END, l[i + 1].story, stop, CASE WHEN ok THEN list_append(took, i + 1) ELSE took END FROM
     (SELECT *, NOT stop AND (len(took) = 0 OR total + l[i + 1].len <= 45000) AS ok FROM (SELECT *, fin OR (story <> l[i + 1].story AND total >= 30000) AS stop FROM w WHERE i < len(l)))),
  k AS (SELECT match_id, l[took[j]].moment_id AS moment_id, j - 1 AS edit_order FROM (SELECT match_id, l, took, unnest(range(1, len(took) + 1)) AS j FROM w WHERE i = len(l)))
  SELECT e.match_id, e.story, e.moment_id, e.role, CAST(edit_order AS INTEGER) AS edit_order, e.end_ms, e.len AS shown_ms FROM e JOIN k ON k.match_id = e.match_id AND k.moment_id = e.moment_id""")
def _(v):
    return R.reel_plan(v.moments.withColumn("hook", F.expr(HOOK)))


THREE = "concat('s', CAST(ordinal % (1 + match_id % 3) AS STRING))"
CHOICE = ["match_id * 8 + ordinal % 8 AS plan_id", "match_id", "CASE WHEN ordinal % 16 < 8 THEN start_ms ELSE ordinal END AS position", "CASE WHEN ordinal % 311 = 7 THEN 'unknown' ELSE moment_id END AS moment_id", "CAST(6000 * (1 + ordinal % 8) AS BIGINT) AS target_ms"]
CHOSEN = f"selected AND {SOUND} AND NOT {REACT}"
NEEDS = "CASE WHEN g THEN 'goal' WHEN d THEN 'disallowed_goal' ELSE 'decision' END"
DECIDED = f"semantic_verified IS TRUE AND keep_decision <> 'reject' AND tracking_decision IN ({', '.join(repr(x) for x in VERIFIED_DECISIONS)})"


@query("story_check", f"""WITH RECURSIVE mo AS (SELECT * REPLACE ({THREE} AS story_id) FROM moments_v), pl AS (SELECT {', '.join(CHOICE)} FROM mo WHERE {CHOSEN} UNION ALL SELECT {', '.join(CHOICE)} FROM mo WHERE {CHOSEN} AND ordinal % 37 = 5),
  ap AS (SELECT plan_id, any_value(match_id) AS match_id, max(target_ms) AS target_ms FROM pl GROUP BY plan_id), pk AS (SELECT pl.plan_id, pl.position, pl.moment_id AS chosen, mo.* FROM pl LEFT JOIN mo ON mo.match_id = pl.match_id AND mo.moment_id = pl.moment_id),
  sn AS (SELECT DISTINCT * REPLACE (plan_id AS match_id) FROM (SELECT * EXCLUDE (position) FROM pk WHERE moment_id IS NOT NULL)), {UNIQUE_SQL},
  v1 AS (SELECT plan_id FROM pk GROUP BY plan_id HAVING count(DISTINCT chosen) < count(chosen) OR count(moment_id) < count(chosen)),
  v2 AS (SELECT DISTINCT plan_id FROM (SELECT plan_id, start_ms, lag(start_ms) OVER (PARTITION BY plan_id ORDER BY position) AS last FROM pk WHERE moment_id IS NOT NULL) WHERE start_ms < last),
  nd AS (SELECT match_id, story_id, bool_or(event_type = 'goal') AS g, bool_or(event_type = 'disallowed_goal') AS d FROM mo WHERE semantic_verified AND event_type IN ('goal', 'var', 'offside', 'disallowed_goal') GROUP BY ALL),
  v3 AS (SELECT DISTINCT plan_id FROM ap JOIN nd ON nd.match_id = ap.match_id WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.plan_id = ap.plan_id AND sn.story_id = nd.story_id AND {DECIDED} AND
    CASE WHEN g THEN event_type = 'goal' AND action_complete IS TRUE AND (NOT {REPLAY} OR angle_selected) WHEN d THEN event_type = 'disallowed_goal' AND action_complete IS TRUE ELSE event_type IN ('offside', 'var') AND action_complete IS NOT FALSE AND tracking_passed IS NOT FALSE END)),
  kp AS (SELECT rk.* FROM fin JOIN rk USING (match_id, rn)), v4 AS (SELECT DISTINCT plan_id FROM sn WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp.match_id = sn.match_id AND kp.moment_id = sn.moment_id)),
  cp AS (SELECT match_id, sum(CASE WHEN {REACT} THEN least(3000e0, end_ms - start_ms) ELSE least(12000e0, (end_ms - start_ms) / 0.72e0) + 1000 END) AS capacity FROM kp GROUP BY match_id),
  v5 AS (SELECT plan_id FROM ap LEFT JOIN cp ON cp.match_id = ap.plan_id WHERE target_ms < 10000 OR target_ms > 40010 OR target_ms > coalesce(capacity, 0) + 10)
  SELECT plan_id, array_to_string([x FOR x IN [CASE WHEN plan_id IN (FROM v1) THEN 'candidates' END, CASE WHEN plan_id IN (FROM v2) THEN 'order' END, CASE WHEN plan_id IN (FROM v3) THEN 'coverage' END, CASE WHEN plan_id IN (FROM v4) THEN 'unique' END, CASE WHEN plan_id IN (FROM v5) THEN 'duration' END] IF x IS NOT NULL], ',') AS violations FROM ap""")
def _(v):
    m = v.moments.withColumn("story_id", F.expr(THREE))
    chosen = m.where(CHOSEN).selectExpr(*CHOICE)
    return R.story_check(chosen.unionByName(m.where(CHOSEN).where("ordinal % 37 = 5").selectExpr(*CHOICE)), m, 10_000, 40_000)
