"""Queries over source windows, shots, gaps and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators import ledger as L
from matchspark.operators import windows as W
from matchspark.operators.timeline import block_of, scan
from matchspark.plans.catalog.ledger import LEDGER_SQL, ledger
from matchspark.plans.registry import query

# sources of varying length, so tiles and tails differ per match
SRC_SQL = "src AS (SELECT match_id, 300000 + count(*) * 9137 AS duration_ms FROM moments_v GROUP BY match_id)"
TILES_SQL = """tiles AS (SELECT match_id, duration_ms, i + 1 AS section, i * {step} AS start_ms, least({chunk}, duration_ms - i * {step}) AS length_ms
  FROM src, (SELECT unnest(range(200)) AS i) WHERE i * {step} < duration_ms - 50 AND (i = 0 OR duration_ms - i * {step} > {lap} + 50))"""
T4 = TILES_SQL.format(step=176000, chunk=180000, lap=4000)
T6 = TILES_SQL.format(step=174000, chunk=180000, lap=6000)
VERIFIED_SQL = f"(SELECT * FROM moments_v WHERE {S.coverage_state_sql()} = 'verified')"


def src(v):
    return v.moments.groupBy("match_id").agg((F.lit(300_000) + F.count(F.lit(1)) * 9137).alias("duration_ms"))


@query("section_windows", f"WITH {SRC_SQL}, {T4} SELECT match_id, section, start_ms, length_ms FROM tiles")
def _(v):
    return W.section_windows(src(v)).drop("duration_ms")


PLAN_SQL = f"""{SRC_SQL}, {T6}, plan AS (SELECT match_id, section, start_ms, length_ms, core AS core_end_ms,
   CAST(floor(least(duration_ms, 90000) * (core - start_ms) / duration_ms + 0.5e0) AS BIGINT) AS requested_ms
  FROM (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY match_id ORDER BY start_ms), duration_ms) AS core FROM tiles))"""


@query("section_plan", f"WITH {PLAN_SQL} SELECT * FROM plan")
def _(v):
    return W.section_plan(src(v))


RAW_SHOTS = ["match_id", "ordinal AS index", "start_ms - 3000000 AS shot_start_ms", "CASE WHEN k % 4 = 0 THEN start_ms - 2999900 ELSE end_ms - 3000000 END AS shot_end_ms"]


@query("shot_inventory", f"""WITH {SRC_SQL}, r AS (SELECT {', '.join(RAW_SHOTS)} FROM moments_v JOIN (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) ON event_id = ordinal)
  SELECT * FROM (SELECT match_id, printf('shot-%04d', index) AS shot_id, least(greatest(0, shot_start_ms), duration_ms) AS start_ms, least(greatest(0, shot_end_ms), duration_ms) AS end_ms
    FROM r JOIN src USING (match_id)) WHERE end_ms - start_ms >= 250""")
def _(v):
    raw = v.moments.withColumn("k", F.col("confidence")).drop("k").join(
        v.base.select(F.col("event_id").alias("ordinal"), "k"), "ordinal").selectExpr(*RAW_SHOTS)
    return W.shot_inventory(raw, src(v))


@query("clip_shots", f"""WITH {SRC_SQL}, {T4} SELECT s.match_id, section, shot_id, greatest(shot_start_ms, start_ms) - start_ms AS local_start_ms,
   least(shot_end_ms, start_ms + length_ms) - start_ms AS local_end_ms, greatest(shot_start_ms, start_ms) AS source_start_ms, least(shot_end_ms, start_ms + length_ms) AS source_end_ms
  FROM shots_v s JOIN tiles t ON t.match_id = s.match_id AND shot_start_ms < start_ms + length_ms AND start_ms < shot_end_ms
  WHERE least(shot_end_ms, start_ms + length_ms) - greatest(shot_start_ms, start_ms) >= 250""")
def _(v):
    return W.clip_shots(v.shots, W.section_windows(src(v)))


@query("passage_fits", """WITH led AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY shot_start_ms) AS shot_no FROM shots_v),
  pas AS (SELECT m.match_id, m.moment_id, start_ms, end_ms, [a.shot_id, b.shot_id] AS ids, a.shot_no AS n0, b.shot_no AS n1, a.shot_start_ms AS s0, coalesce(b.shot_end_ms, a.shot_end_ms) AS e1, b.shot_id AS second
    FROM moments_v m JOIN led a ON a.match_id = m.match_id AND a.shot_start_ms = m.start_ms
    LEFT JOIN led b ON b.match_id = m.match_id AND b.shot_no = a.shot_no + CASE WHEN m.ordinal % 5 = 0 THEN 2 ELSE 1 END AND m.ordinal % 3 <> 0)
  SELECT match_id, moment_id, (second IS NULL OR n1 = n0 + 1) AND start_ms >= s0 - 80 AND end_ms <= e1 + 80 AS fits FROM pas""")
def _(v):
    led = scan(v.shots, ["match_id"], ["shot_start_ms"], block_of(F.col("shot_start_ms"), 600_000), upto={"shot_no": ("count", F.lit(1))})
    a = led.select("match_id", F.col("shot_start_ms").alias("start_ms"), F.col("shot_id").alias("a_id"), F.col("shot_no").alias("a_no"))
    b = led.select("match_id", F.col("shot_id").alias("b_id"), F.col("shot_no").alias("b_no"))
    want = F.col("a_no") + F.when(F.expr("ordinal % 5 = 0"), 2).otherwise(1)
    pas = (
        v.moments.select("match_id", "moment_id", "ordinal", "start_ms", "end_ms").join(a, ["match_id", "start_ms"])
        .withColumn("b_no", F.when(F.expr("ordinal % 3 <> 0"), want)).join(b, ["match_id", "b_no"], "left")
        .withColumn("shot_ids", F.array_compact(F.array("a_id", "b_id")))
    )
    return W.passage_fits(pas, led)


@query("covered_seconds", """SELECT match_id, story_id, CAST(sum(greatest(0, end_ms - greatest(start_ms, coalesce(reach, start_ms)))) AS BIGINT) AS covered_ms
  FROM (SELECT *, max(end_ms) OVER (PARTITION BY match_id, story_id ORDER BY start_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM moments_v)
  GROUP BY ALL""")
def _(v):
    return W.covered_seconds(v.moments, ["match_id", "story_id"])


def gaps_sql(name: str, min_gap: int) -> str:
    return f"""{name}_span AS (SELECT match_id, ordinal, start_ms AS s, least(end_ms, 5400000) AS e FROM {VERIFIED_SQL} WHERE least(end_ms, 5400000) > start_ms),
 {name}_edge AS (SELECT match_id, min(s) AS first_s, arg_max(e, struct_pack(s := s, o := ordinal)) AS last_e, max(e) AS reach FROM {name}_span GROUP BY match_id),
 {name}_gap AS (SELECT match_id, coalesce(max(e) OVER (PARTITION BY match_id ORDER BY s, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, s AS g1 FROM {name}_span
   UNION ALL SELECT match_id, coalesce(reach, 0), duration_ms FROM sources_v LEFT JOIN {name}_edge USING (match_id)),
 {name}_cut AS (SELECT *, CAST(ceil((g1 - g0) / 42000) AS BIGINT) AS n FROM {name}_gap WHERE g1 - g0 >= {min_gap}),
 {name} AS (SELECT c.match_id, CAST(floor(greatest(0, g0 + i * ((g1 - g0) / n) - CASE WHEN i > 0 THEN 1500 ELSE 0 END)) AS BIGINT) AS start_ms,
    CAST(floor(least(5400000, g0 + (i + 1) * ((g1 - g0) / n) + CASE WHEN i < n - 1 THEN 1500 ELSE 0 END)) AS BIGINT) AS end_ms, round((g1 - g0) / n, 3) AS uncovered_ms,
    g0 >= coalesce(first_s, 5400000) AND g1 <= coalesce(last_e, 0) AS interior, first_s IS NOT NULL AND g0 < first_s AS opening
   FROM {name}_cut c LEFT JOIN {name}_edge x ON x.match_id = c.match_id, (SELECT unnest(range(200)) AS i) WHERE i < n)"""


# union of earlier searches, merged into disjoint spans
MERGED_SQL = """sch AS (SELECT match_id, s_start_ms AS s, max(s_end_ms) AS e FROM searched_v GROUP BY ALL),
 sch2 AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY match_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS op FROM sch),
 sch3 AS (SELECT *, sum(op) OVER (PARTITION BY match_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM sch2),
 merged AS (SELECT match_id, g, min(s) AS s, max(e) AS e FROM sch3 GROUP BY ALL)"""


def fresh_sql(name: str, base: str) -> str:
    return f"""{name} AS (SELECT b.* FROM {base} b WHERE coalesce((SELECT sum(greatest(0, least(b.end_ms, m.e) - greatest(b.start_ms, m.s))) FROM merged m WHERE m.match_id = b.match_id), 0) < (b.end_ms - b.start_ms) * 0.85e0)"""


@query("coverage_gaps", f"WITH {gaps_sql('gaps', 8000)} SELECT * FROM gaps")
def _(v):
    return W.coverage_gaps(v.moments, v.sources)


@query("rank_gaps", f"""WITH {gaps_sql('gaps', 8000)}, {MERGED_SQL}, {fresh_sql('fresh', 'gaps')}
  SELECT match_id, start_ms, end_ms FROM fresh QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY (interior OR opening) DESC, uncovered_ms DESC, start_ms) <= 4""")
def _(v):
    return W.rank_gaps(W.coverage_gaps(v.moments, v.sources), v.searched, v.sources)


CHOP_SQL = """clip AS (SELECT match_id, least(greatest(0, start_ms), 5400000) AS s, least(greatest(0, end_ms), 5400000) AS e FROM {src}),
 chop AS (SELECT DISTINCT match_id, s + i * 32000 AS start_ms, least(e, s + i * 32000 + 42000) AS end_ms FROM clip, (SELECT unnest(range(40)) AS i)
   WHERE e - s >= 2000 AND i <= greatest(0, ceil((e - s - 42000) / 32000)))"""


@query("chop_windows", f"WITH {CHOP_SQL.format(src='(SELECT match_id, start_ms - 60000 AS start_ms, CASE WHEN ordinal % 9 = 0 THEN start_ms - 59000 ELSE end_ms + 60000 END AS end_ms FROM moments_v)')} SELECT * FROM chop")
def _(v):
    wide = v.moments.selectExpr("match_id", "start_ms - 60000 AS start_ms", "CASE WHEN ordinal % 9 = 0 THEN start_ms - 59000 ELSE end_ms + 60000 END AS end_ms")
    return W.chop_windows(wide, v.sources)


@query("goal_gap_windows", f"""{LEDGER_SQL}, {CHOP_SQL.format(src='(SELECT match_id // 1000 AS match_id, x.s - 10000 AS start_ms, x.e + 10000 AS end_ms FROM (SELECT match_id, unnest(gaps) AS x FROM final))')},
  {MERGED_SQL}, {fresh_sql('hot', 'chop')}, {gaps_sql('gaps', 4000)}, {fresh_sql('cold', 'gaps')},
  a AS (SELECT match_id, start_ms, end_ms, 'score_jump' AS origin FROM hot QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY start_ms, end_ms) <= 4),
  b AS (SELECT match_id, greatest(0, start_ms - 2000) AS start_ms, least(5400000, end_ms + 2000) AS end_ms, 'gap' AS origin FROM cold
     QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY (interior OR opening) DESC, uncovered_ms DESC, cold.start_ms) <= 4)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE match_id NOT IN (SELECT match_id FROM a)""")
def _(v):
    jumps = L.ledger_unresolved(ledger(v)).select(F.expr("match_id div 1000").alias("match_id"), "start_ms", "end_ms")  # periods of a match
    return W.goal_gap_windows(jumps, v.moments, v.sources, v.searched)


@query("unobserved_shots", f"""WITH {MERGED_SQL}, cut AS (SELECT match_id, shot_id, shot_start_ms AS start_ms, least(shot_end_ms, 5400000) AS end_ms FROM shots_v WHERE least(shot_end_ms, 5400000) - shot_start_ms >= 2000)
  SELECT match_id, shot_id, start_ms, end_ms FROM cut c
  WHERE coalesce((SELECT sum(greatest(0, least(c.end_ms, m.e) - greatest(c.start_ms, m.s))) FROM merged m WHERE m.match_id = c.match_id), 0) < c.end_ms - c.start_ms - 100
   AND NOT EXISTS (SELECT 1 FROM moments_v q WHERE q.match_id = c.match_id AND q.semantic_verified AND q.action_complete AND q.keep_decision <> 'reject' AND NOT q.angle_deferred AND NOT q.support_deferred
      AND least(q.end_ms, c.end_ms) - greatest(q.start_ms, c.start_ms) >= (c.end_ms - c.start_ms) * 0.95e0)
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY c.end_ms - c.start_ms DESC, start_ms) <= 4""")
def _(v):
    return W.unobserved_shots(v.shots, v.moments, v.searched, v.sources)


SEG_SQL = """seg AS (SELECT m.match_id, m.moment_id, shot_id, greatest(start_ms, shot_start_ms) AS seg_start_ms, least(end_ms, shot_end_ms) AS seg_end_ms
  FROM moments_v m JOIN shots_v s ON s.match_id = m.match_id AND shot_end_ms > start_ms + 30 AND shot_start_ms < end_ms - 30 {where})"""


@query("camera_segments", f"WITH {SEG_SQL.format(where='')} SELECT * FROM seg")
def _(v):
    return W.camera_segments(v.moments, v.shots)


ACT_SQL = ", ".join(f"'{e}'" for e in W.ACTION_EVENTS)


@query("split_views", f"""WITH {SEG_SQL.format(where=f"WHERE (score_observation OR additional_action) AND NOT view_split AND event_type IN ({ACT_SQL})")}
  SELECT match_id, moment_id || '-shot-' || row_number() OVER (PARTITION BY match_id, moment_id ORDER BY seg_start_ms, shot_id) AS moment_id, moment_id AS parent_id, seg_start_ms AS start_ms, seg_end_ms AS end_ms
   FROM seg WHERE seg_end_ms - seg_start_ms >= 2500 AND (match_id, moment_id) IN (SELECT (match_id, moment_id) FROM seg GROUP BY match_id, moment_id HAVING count(*) >= 2)
  UNION ALL SELECT match_id, moment_id, NULL, start_ms, end_ms FROM moments_v""")
def _(v):
    return W.split_views(v.moments, v.shots)


@query("score_shot_proposals", """SELECT a.match_id, concat_ws('-', 'score-shot', anchor_id, shot_start_ms, shot_end_ms) AS moment_id, anchor_id AS story_id,
   CASE WHEN status = 'reversed' THEN 'disallowed_goal' ELSE 'goal' END AS event_type, shot_start_ms AS start_ms, shot_end_ms AS end_ms
  FROM anchors_v a JOIN shots_v s ON s.match_id = a.match_id AND shot_end_ms - shot_start_ms BETWEEN 2500 AND 45000 AND shot_end_ms > search_start_ms AND shot_start_ms < after_ms""")
def _(v):
    return W.score_shot_proposals(v.anchors, v.shots, v.moments)


@query("trim_views", """SELECT moment_id, coalesce(ok, false) AS trimmed, CASE WHEN ok THEN e ELSE end_ms END AS end_ms FROM (
   SELECT *, view_split AND semantic_verified AND action_complete AND proof_verified AND payoff_end_ms > contact_ms AND payoff_end_ms <= end_ms AND end_ms - e >= 150 AND e - start_ms >= 2500 AS ok
   FROM (SELECT *, least(end_ms, greatest(payoff_end_ms, proof_end_ms - 1500) + 500) AS e FROM moments_v))""")
def _(v):
    return W.trim_views(v.moments.withColumn("proof_end_ms", F.col("proof_end_ms") - 1500)).select("moment_id", "trimmed", "end_ms")


@query("trim_to_origin", """SELECT moment_id, coalesce(ok, false) AS trimmed, CASE WHEN ok THEN s ELSE start_ms END AS start_ms FROM (
   SELECT *, selection_locked IS NOT TRUE AND NOT (semantic_verified IS TRUE AND action_complete IS TRUE AND ordinal % 4 = 0) AND NOT (event_type = 'celebration' OR story_phase = 'reaction')
      AND origin2 > start_ms AND s > start_ms + 500 AND end_ms - s >= 3000 AS ok
   FROM (SELECT *, origin_ms + 1500 AS origin2, greatest(start_ms, origin_ms + 1500 - CASE WHEN is_replay OR story_phase = 'replay' THEN 100 ELSE 1200 END) AS s FROM moments_v))""")
def _(v):
    rows = v.moments.withColumn("origin_ms", F.col("origin_ms") + 1500).withColumn("window_exact", F.expr("ordinal % 4 = 0"))
    return W.trim_to_origin(rows).select("moment_id", "trimmed", "start_ms")


@query("align_to_shots", """WITH m AS (SELECT *, (is_replay OR story_phase = 'replay') AS rep FROM moments_v WHERE selection_locked IS NOT TRUE
      AND event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance', 'free_kick')),
  t AS (SELECT m.*, (SELECT min(shot_start_ms) FROM shots_v s WHERE s.match_id = m.match_id AND contact_ms BETWEEN shot_start_ms AND shot_end_ms) AS touch FROM m),
  f AS (SELECT *, rep AND abs(origin_ms - start_ms) <= 150 AND contact_ms - origin_ms > 3000 AND coalesce(touch > origin_ms + 1000, false) AS moved FROM t),
  g AS (SELECT *, CASE WHEN moved THEN touch ELSE origin_ms END AS fr FROM f),
  h AS (SELECT g.*, (SELECT min(shot_start_ms) FROM shots_v s WHERE s.match_id = g.match_id AND fr BETWEEN shot_start_ms AND shot_end_ms) AS f0,
     (SELECT min(struct_pack(a := shot_start_ms, b := shot_end_ms)) FROM shots_v s WHERE s.match_id = g.match_id AND payoff_end_ms BETWEEN shot_start_ms AND shot_end_ms) AS l FROM g),
  b AS (SELECT *, CASE WHEN moved THEN fr ELSE greatest(f0, fr - CASE WHEN event_type = 'goal' AND rep THEN 100 ELSE 1200 END) END AS base,
     least(end_ms, payoff_end_ms + CASE WHEN rep THEN 650 ELSE 1150 END) AS ge FROM h WHERE fr <= contact_ms AND contact_ms < payoff_end_ms AND f0 IS NOT NULL AND l.a >= f0),
  c AS (SELECT *, CASE WHEN event_type = 'goal' THEN greatest(start_ms, base) ELSE base END AS ns, CASE WHEN event_type = 'goal' THEN ge ELSE end_ms END AS ne FROM b)
  SELECT match_id, moment_id, ns AS new_start_ms, ne AS new_end_ms, coalesce(moved, false) AS origin_moved, f0 AS shot_start_ms, l.b AS shot_end_ms FROM c
  WHERE CASE WHEN event_type = 'goal' THEN (ns > start_ms + 40 OR ne < end_ms - 40) AND ns <= contact_ms - 1000 AND ne - ns >= 3000
    ELSE (coalesce(tracking_decision = 'unstable_camera', false) OR contact_ms >= end_ms - 450 OR payoff_end_ms >= end_ms - 120) AND end_ms >= contact_ms + 700 AND end_ms - ns >= 3000 AND abs(ns - start_ms) > 40 END""")
def _(v):
    return W.align_to_shots(v.moments.withColumn("window_exact", F.lit(False)), v.shots)


@query("extend_to_result", """SELECT moment_id, coalesce(ok, false) AS extended, CASE WHEN ok THEN e ELSE end_ms END AS end_ms FROM (
   SELECT *, NOT view_split AND event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance') AND e IS NOT NULL AND e > end_ms + 80 AND NOT (e < start_ms + rel_contact_ms + 550) AS ok
   FROM (SELECT m.*, rel_contact_ms, CASE WHEN rel_payoff_end_ms IS NOT NULL THEN least(m.end_ms + 4000, m.start_ms + greatest(rel_contact_ms, coalesce(rel_flight_ms, 0), rel_payoff_start_ms, rel_payoff_end_ms)
       + CASE WHEN event_type IN ('goal', 'disallowed_goal') THEN 800 ELSE 550 END) END AS e FROM moments_v m LEFT JOIN reviews_v r USING (match_id, moment_id)))""")
def _(v):
    rev = v.reviews.select("match_id", "moment_id", "rel_contact_ms", "rel_flight_ms", "rel_payoff_start_ms", "rel_payoff_end_ms")
    return W.extend_to_result(v.moments.withColumn("limit_ms", F.col("end_ms") + 4000), rev).select("moment_id", "extended", "end_ms")


@query("review_windows", """SELECT m.match_id, moment_id, start_ms, CASE WHEN view_split OR selection_locked IS TRUE THEN end_ms
    WHEN event_type IN ('assist', 'skill', 'dribble', 'tackle', 'free_kick', 'normal_play') THEN least(5400000, end_ms + 2000)
    WHEN event_type NOT IN ('goal', 'disallowed_goal') OR is_replay OR story_phase = 'replay' THEN end_ms
    WHEN score_observation THEN least(5400000, end_ms + 2000)
    ELSE least(5400000, greatest(end_ms, coalesce((SELECT max(c.end_ms) FROM moments_v c WHERE c.match_id = m.match_id AND c.story_id = m.story_id AND c.moment_id <> m.moment_id
       AND c.start_ms BETWEEN m.start_ms AND m.end_ms + 12000), 0))) END AS end_ms FROM moments_v m""")
def _(v):
    return W.review_windows(v.moments, v.sources)


@query("outcome_windows", """WITH a AS (SELECT *, view_split AND end_ms - start_ms <= 12000 AS whole FROM moments_v),
  b AS (SELECT *, CASE WHEN NOT whole AND contact_ms IS NOT NULL THEN greatest(start_ms, least(end_ms - 10, contact_ms - 1500)) ELSE start_ms END AS lo FROM a),
  c AS (SELECT *, CASE WHEN NOT whole AND payoff_end_ms > lo THEN least(end_ms, payoff_end_ms + 600) ELSE end_ms END AS hi, box_x2 <= 1 AND box_y2 <= 1 AND box_x2 > box_x1 AND box_y2 > box_y1 AS boxed,
    least(1e0, greatest(0.5e0, box_x2 - box_x1 + 0.24e0)) AS w, least(1e0, greatest(0.8e0, box_y2 - box_y1 + 0.4e0)) AS h FROM b),
  d AS (SELECT *, greatest(0e0, least(1 - w, (box_x1 + box_x2) / 2 - w / 2)) AS x, greatest(0e0, least(1 - h, (box_y1 + box_y2) / 2 - h / 2)) AS y FROM c)
  SELECT match_id, moment_id, lo AS from_ms, least(end_ms, greatest(lo + 10, hi)) AS to_ms, round(least(8e0, 48000e0 / greatest(10, hi - lo)), 4) AS fps,
    CASE WHEN boxed THEN CAST(floor(x * 1920 / 2) * 2 AS BIGINT) END AS crop_x, CASE WHEN boxed THEN CAST(floor(y * 1080 / 2) * 2 AS BIGINT) END AS crop_y,
    CASE WHEN boxed THEN CAST(floor(w * 1920 / 2) * 2 AS BIGINT) END AS crop_w, CASE WHEN boxed THEN CAST(floor(h * 1080 / 2) * 2 AS BIGINT) END AS crop_h FROM d""")
def _(v):
    return W.outcome_windows(v.moments, v.sources)


@query("blocked_windows", """WITH t AS (SELECT m.match_id, m.moment_id, m.start_ms, m.end_ms, min(shot_start_ms) AS t0, max(shot_end_ms) AS t1 FROM moments_v m JOIN shots_v s ON s.match_id = m.match_id
     AND shot_end_ms > m.start_ms AND shot_start_ms < m.end_ms WHERE m.selection_locked GROUP BY ALL),
  w AS (SELECT match_id, moment_id, greatest(0, least(start_ms - 2000, t0)) AS w0, least(5400000, greatest(end_ms + 2000, t1)) AS w1 FROM t)
  SELECT w.match_id, moment_id, w0 AS win_start_ms, w1 AS win_end_ms, greatest(w0, shot_start_ms) - w0 AS local_start_ms, least(w1, shot_end_ms) - w0 AS local_end_ms
  FROM w JOIN shots_v s ON s.match_id = w.match_id AND shot_end_ms > w0 AND shot_start_ms < w1""")
def _(v):
    return W.blocked_windows(v.moments.where("selection_locked"), v.shots, v.sources)


@query("reel_manifest", """SELECT match_id, story_id, moment_id, CAST(coalesce(sum(len) OVER (PARTITION BY match_id, story_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reel_start_ms,
   CAST(sum(len) OVER (PARTITION BY match_id, story_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reel_end_ms FROM (SELECT *, end_ms - start_ms AS len FROM moments_v)""")
def _(v):
    clips = v.moments.select("match_id", "story_id", "moment_id", "ordinal", S.length_ms().alias("length_ms"))
    return W.reel_manifest(clips, ["match_id", "story_id"], ["ordinal"], F.floor(F.col("ordinal") / 4096)).drop("ordinal", "length_ms")


PH = """SELECT match_id, moment_id, start_ms AS scene_start_ms, end_ms AS scene_end_ms, {cols} FROM moments_v WHERE contact_ms IS NOT NULL AND flight_ms IS NOT NULL"""
PH_ROWS = [(1, "start_ms", "contact_ms"), (2, "contact_ms", "CASE WHEN ordinal % 3 = 0 THEN contact_ms WHEN ordinal % 3 = 1 THEN contact_ms + 200 ELSE contact_ms + 250 END"),
           (3, "contact_ms + CASE WHEN ordinal % 3 = 2 THEN 250 WHEN ordinal % 3 = 1 THEN 325 ELSE 125 END", "payoff_start_ms"),
           (4, "payoff_start_ms", "CASE WHEN ordinal % 7 = 0 THEN end_ms - 500 WHEN ordinal % 7 = 1 THEN end_ms - 125 ELSE end_ms END")]


@query("timeline_tiling", "WITH p AS (" + " UNION ALL ".join(PH.format(cols=f"{n} AS phase_no, {a} AS p_start_ms, {b} AS p_end_ms") for n, a, b in PH_ROWS) + """),
  d AS (SELECT *, CASE WHEN p_end_ms = p_start_ms OR coalesce(lead(p_start_ms) OVER w, scene_end_ms) - p_end_ms = 125 THEN least(scene_end_ms, p_end_ms + 125) ELSE p_end_ms END AS de FROM p WINDOW w AS (PARTITION BY match_id, moment_id ORDER BY phase_no)),
  e AS (SELECT *, abs(p_start_ms - coalesce(lag(de) OVER (PARTITION BY match_id, moment_id ORDER BY phase_no), scene_start_ms)) <= 1 AND de > p_start_ms AND de <= scene_end_ms + 1 AS ok FROM d)
  SELECT match_id, moment_id, count(*) AS phases, bool_and(ok) AND abs(arg_max(de, phase_no) - max(scene_end_ms)) <= 1 AS tiles FROM e GROUP BY ALL""")
def _(v):
    base = v.moments.where("contact_ms IS NOT NULL AND flight_ms IS NOT NULL")
    rows = [f"struct({n} AS phase_no, {a} AS p_start_ms, {b} AS p_end_ms)" for n, a, b in PH_ROWS]
    phases = base.selectExpr("match_id", "moment_id", "start_ms AS scene_start_ms", "end_ms AS scene_end_ms", f"inline(array({', '.join(rows)}))")
    return W.timeline_tiling(phases)


@query("output_clock", """WITH r AS (SELECT *, coalesce(edit_order, 0) AS ek, CAST(floor((end_ms - start_ms) / greatest(0.72e0, least(1e0, playback_rate))) AS BIGINT) + CASE WHEN effect = 'freeze_analysis' THEN greatest(400, least(1000, freeze_ms)) ELSE 0 END AS out_ms,
     greatest(40, least(360, transition_ms)) AS fade FROM moments_v WHERE selected),
  n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ek, ordinal) AS slot FROM r),
  c AS (SELECT match_id, moment_id, slot, sum(out_ms) OVER w - out_ms - sum(CASE WHEN slot > 1 THEN fade ELSE 0 END) OVER w AS s, out_ms FROM n WINDOW w AS (PARTITION BY match_id ORDER BY slot ROWS UNBOUNDED PRECEDING))
  SELECT match_id, moment_id, slot, CAST(s AS BIGINT) AS out_start_ms, CAST(s + out_ms AS BIGINT) AS out_end_ms FROM c""")
def _(v):
    return W.output_clock(v.moments.where("selected"), F.floor(F.col("edit_key") / 4))


CUTS = ["match_id", "scene_id AS batch", "frame AS cut_no", "100 * frame + CASE WHEN scene_id % 3 = 2 AND k % 25 = 0 THEN 5 ELSE 0 END AS cut_start_ms", "100 + (scene_id + match_id) % 2 AS cut_ms"]
CUTS = CUTS[:4] + ["CAST(100 AS BIGINT) AS cut_ms"]
BATCH = "match_id, batch, count(*) * 100 AS planned_ms, count(*) * 100 + (match_id * 7 + batch * 13) % 140 AS measured_ms"


@query("encoded_clock", f"""WITH c AS (SELECT {', '.join(CUTS)} FROM frames_v), b AS (SELECT {BATCH} FROM c GROUP BY match_id, batch),
  r AS (SELECT c.*, planned_ms, measured_ms, cut_ms > 0 AND abs(cut_start_ms - coalesce(lag(cut_start_ms + cut_ms) OVER w, 0)) <= 2 AS ok, lead(cut_no) OVER w IS NULL AS last_cut FROM c JOIN b USING (match_id, batch) WINDOW w AS (PARTITION BY match_id, batch ORDER BY cut_no)),
  g AS (SELECT *, bool_and(ok AND (NOT last_cut OR (abs(cut_start_ms + cut_ms - planned_ms) <= 2 AND measured_ms > cut_start_ms))) OVER (PARTITION BY match_id, batch) AS good FROM r),
  p AS (SELECT *, CASE WHEN abs(measured_ms - planned_ms) > 120 THEN 'clock_disagrees' WHEN NOT good THEN 'cut_out_of_order' END AS problem FROM g)
  SELECT match_id, batch, cut_no, cut_start_ms, CASE WHEN problem IS NULL AND last_cut THEN measured_ms - cut_start_ms ELSE cut_ms END AS cut_ms, problem FROM p""")
def _(v):
    cuts = v.frames.selectExpr(*CUTS)
    return W.encoded_clock(cuts, cuts.groupBy("match_id", "batch").count().selectExpr("match_id", "batch", "count * 100 AS planned_ms", "count * 100 + (match_id * 7 + batch * 13) % 140 AS measured_ms"))


QUEUE = ["match_id", "moment_id", "start_ms + CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END AS q_start_ms", "end_ms AS q_end_ms"]
QUEUE_WHERE = "(selection_locked AND ordinal % 11 <> 3) OR ordinal % 23 = 4"


@query("locked_queue_check", f"""WITH q AS (SELECT {', '.join(QUEUE)} FROM moments_v WHERE {QUEUE_WHERE}), n AS (SELECT * FROM moments_v WHERE selection_locked)
  SELECT * FROM (SELECT match_id, moment_id, CASE WHEN q_start_ms IS NULL THEN 'not_in_queue' WHEN start_ms IS NULL THEN 'missing_scene' WHEN start_ms <> q_start_ms OR end_ms <> q_end_ms THEN 'interval_changed'
    WHEN tracking_passed IS NOT TRUE THEN 'pending' END AS issue FROM q FULL JOIN n USING (match_id, moment_id)) WHERE issue IS NOT NULL""")
def _(v):
    return W.locked_queue_check(v.moments.where(QUEUE_WHERE).selectExpr(*QUEUE), v.moments)


@query("sample_times", """WITH a AS (SELECT match_id, moment_id, start_ms AS s, end_ms AS e, greatest(start_ms, end_ms - 10) AS cap, contact_ms AS c, payoff_start_ms AS p, payoff_end_ms AS q FROM moments_v),
  t AS (SELECT match_id, moment_id, 0 AS pr, s AS t_ms FROM a UNION ALL SELECT match_id, moment_id, 1, greatest(s, e - 50) FROM a
   UNION ALL SELECT match_id, moment_id, 2 + d.i, least(cap, greatest(s, CASE d.i // 3 WHEN 0 THEN c WHEN 1 THEN p ELSE q END + 125 * (d.i % 3 - 1))) FROM a, (SELECT unnest(range(9)) AS i) d WHERE d.i // 3 > 0 OR c IS NOT NULL
   UNION ALL SELECT match_id, moment_id, 11 + d.i, s + CAST(floor((e - s - 10) * d.i / 11) AS BIGINT) FROM a, (SELECT unnest(range(1, 12)) AS i) d),
  f AS (SELECT match_id, moment_id, t_ms, min(pr) AS pr FROM t GROUP BY ALL)
  SELECT match_id, moment_id, t_ms FROM f QUALIFY row_number() OVER (PARTITION BY match_id, moment_id ORDER BY pr) <= 12""")
def _(v):
    return W.sample_times(v.moments)


BATCH = ["match_id", "moment_id", "ordinal", "CASE WHEN ordinal % 97 < 90 AND event_type IN ('goal', 'save') THEN 'tackle' ELSE event_type END AS event_type", "ordinal % 29 = 5 AS score_observation", "ordinal % 31 = 8 AS additional_action", "start_ms", "end_ms"]
BATCH_ROWS = """SELECT *, coalesce(score_observation, false) OR coalesce(additional_action, false) OR coalesce(event_type IN ('goal', 'disallowed_goal', 'save', 'shot_on_target', 'shot_off_target', 'big_chance'), false) AS alone,
    greatest(500, end_ms - start_ms) AS ms, row_number() OVER (PARTITION BY match_id ORDER BY ordinal) AS rn"""


@query("review_batches", f"""WITH RECURSIVE m AS MATERIALIZED ({BATCH_ROWS} FROM (SELECT {', '.join(BATCH)} FROM moments_v)),
  w(match_id, rn, moment_id, batch, n, ms) AS (SELECT match_id, rn, moment_id, 1::BIGINT, CASE WHEN alone THEN 0 ELSE 1 END, CASE WHEN alone THEN 0::BIGINT ELSE CAST(ms AS BIGINT) END FROM m WHERE rn = 1 UNION ALL
    SELECT m.match_id, m.rn, m.moment_id, CASE WHEN alone OR w.n = 0 OR w.n >= 4 OR w.ms + m.ms > 45000 THEN batch + 1 ELSE batch END, CASE WHEN alone THEN 0 WHEN w.n = 0 OR w.n >= 4 OR w.ms + m.ms > 45000 THEN 1 ELSE w.n + 1 END,
      CAST(CASE WHEN alone THEN 0 WHEN w.n = 0 OR w.n >= 4 OR w.ms + m.ms > 45000 THEN m.ms ELSE w.ms + m.ms END AS BIGINT) FROM w JOIN m ON m.match_id = w.match_id AND m.rn = w.rn + 1)
  SELECT match_id, moment_id, batch FROM w""")
def _(v):
    return W.review_batches(v.moments.selectExpr(*BATCH), block_rows=8)
