"""Queries planning crops and clocks from observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import tracks as T
from matchspark.plans.catalog.tracks import KEYS, NB, SH_SQL, bounds
from matchspark.plans.registry import query

B = lambda n, x, w, y, h, ok: [f"CASE WHEN {ok} THEN {x} END AS {n}_x1", f"CASE WHEN {ok} THEN {x} + {w} END AS {n}_x2", f"CASE WHEN {ok} THEN {y} END AS {n}_y1", f"CASE WHEN {ok} THEN {y} + {h} END AS {n}_y2"]
RQ = ["match_id", "scene_id", "frame", "phase", "CASE WHEN k % 3 = 0 THEN 'result' ELSE 'travel' END AS situation", "CASE match_id % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'save' ELSE 'foul' END AS event_type", "CASE k % 4 WHEN 0 THEN false WHEN 1 THEN true END AS ball_in_play", "phase <> 'payoff' AS need_player",
      *B("b", "ball_x", "0.01e0", "ball_y", "0.01e0", "direct"), *B("p", "coalesce(ball_x, 0.4e0) + (k % 20) / 64e0 - 0.15e0", "0.06e0", "0.4e0", "0.3e0", "k % 9 <> 8"),
      *B("k", "0.1e0 + (k % 50) / 64e0", "0.05e0", "0.3e0", "0.25e0", "k % 2 = 0"), *B("g", "0.05e0 + (k % 30) / 32e0", "0.02e0", "0.2e0", "0.4e0", "k % 5 = 1")]
GAP = lambda a, b: f"sqrt(pow(greatest(0e0, {a}_x1 - {b}_x2, {b}_x1 - {a}_x2), 2) + pow(greatest(0e0, {a}_y1 - {b}_y2, {b}_y1 - {a}_y2), 2))"
FIT = lambda a, b: f"greatest({a}_x2, {b}_x2) - least({a}_x1, {b}_x1) <= 0.316e0"


@query("required_interval", f"""WITH o AS (SELECT {', '.join(RQ)} FROM frames_v), u AS (SELECT *, phase = 'payoff' AND situation = 'result' AS fin, event_type IN ('goal', 'save') AS shot FROM o),
  k AS (SELECT *, coalesce(k_x1 IS NOT NULL AND b_x1 IS NOT NULL AND phase IN ('flight', 'continuation', 'payoff') AND ({GAP('k', 'b')} <= 0.08e0 OR (fin AND shot AND (ball_in_play IS FALSE OR event_type = 'goal'))) AND {FIT('k', 'b')}, false) AS uk,
    coalesce(g_x1 IS NOT NULL AND b_x1 IS NOT NULL AND phase IN ('flight', 'payoff') AND ({GAP('g', 'b')} <= 0.12e0 OR (fin AND shot AND {FIT('g', 'b')})), false) AS ug FROM u),
  s AS (SELECT *, least(b_x1, CASE WHEN need_player THEN p_x1 END, CASE WHEN uk THEN k_x1 END, CASE WHEN ug THEN g_x1 END) AS l, greatest(b_x2, CASE WHEN need_player THEN p_x2 END, CASE WHEN uk THEN k_x2 END, CASE WHEN ug THEN g_x2 END) AS r FROM k),
  m AS (SELECT *, greatest(0e0, least(0.015e0, (0.316e0 - (r - l)) / 2, l, 1 - r)) AS sm FROM s), f AS (SELECT *, greatest(0.158e0, r - 0.158e0 + sm) AS lo0, least(0.842e0, l + 0.158e0 - sm) AS hi0 FROM m)
  SELECT {KEYS}, frame, uk AS keeper_context, ug AS post_context, CASE WHEN l IS NULL THEN 'no_observed_anchor' WHEN lo0 > hi0 + 1e-9 THEN 'cannot_fit' END AS issue, CASE WHEN l IS NOT NULL AND lo0 <= hi0 + 1e-9 THEN round(lo0 + 1e-9, 5) END AS lo, CASE WHEN l IS NOT NULL AND lo0 <= hi0 + 1e-9 THEN round(greatest(lo0, hi0) + 1e-9, 5) END AS hi FROM f""")
def _(v):
    return T.required_interval(v.frames.selectExpr(*RQ), 0.316).select("match_id", "scene_id", "frame", "keeper_context", "post_context", "issue", "lo", "hi")


FI = ["match_id", "scene_id", "frame", "phase", "ball_x", "k % 4 <> 0 AS direct", "k % 3 = 0 AS guided", "CASE WHEN k % 6 <> 5 THEN coalesce(ball_x, 0.5e0) + (k % 16 - 8) / 64e0 END AS px", "CASE WHEN k % 6 <> 5 THEN coalesce(ball_x, 0.5e0) + (k % 16 - 8) / 64e0 - 0.03e0 END AS px1",
      "CASE WHEN k % 6 <> 5 THEN coalesce(ball_x, 0.5e0) + (k % 16 - 8) / 64e0 + 0.03e0 END AS px2", "CASE WHEN phase = 'payoff' AND k % 2 = 0 THEN 0.2e0 + (k % 40) / 64e0 END AS g_x1", "CASE WHEN phase = 'payoff' AND k % 2 = 0 THEN 0.2e0 + (k % 40) / 64e0 + 0.1e0 + (k % 3) / 8e0 END AS g_x2", "possession"]


@query("framing_interval", f"""WITH f AS (SELECT {', '.join(FI)} FROM frames_v), e AS (SELECT *, phase IN ('setup', 'contact') AS ea, CASE WHEN phase IN ('setup', 'contact') THEN 0.3e0 * 0.15e0 ELSE 0.3e0 * 0.09e0 END AS eg FROM f),
  j AS (SELECT *, coalesce(px IS NOT NULL AND (ea OR abs(ball_x - px) <= 0.13e0) AND greatest(ball_x, px2) - least(ball_x, px1) + eg * 2 <= 0.3e0, false) AS jt FROM e), lr AS (SELECT *, CASE WHEN jt THEN least(ball_x, px1) ELSE ball_x END AS l, CASE WHEN jt THEN greatest(ball_x, px2) ELSE ball_x END AS r FROM j),
  a AS (SELECT *, greatest(0.15e0, r + least(eg, greatest(0e0, 1 - r)) - 0.15e0) AS a0, least(0.85e0, l - least(eg, greatest(0e0, l)) + 0.15e0) AS b0 FROM lr), b AS (SELECT *, CASE WHEN a0 > b0 THEN greatest(0.15e0, r - 0.15e0) ELSE a0 END AS a, CASE WHEN a0 > b0 THEN least(0.85e0, l + 0.15e0) ELSE b0 END AS b FROM a),
  c AS (SELECT *, greatest(a, 0.15e0, ball_x - 0.075e0) AS ca, least(b, 0.85e0, ball_x + 0.075e0) AS cb FROM b), d AS (SELECT *, (ea OR (phase = 'payoff' AND possession)) AND ca <= cb AS ce, g_x1 IS NOT NULL AND g_x2 - g_x1 <= 0.3e0 AS bx, ball_x IS NULL OR (NOT direct AND NOT guided) OR a > b AS bl FROM c)
  SELECT {KEYS}, frame, round(CASE WHEN bx THEN greatest(0.15e0, g_x2 - 0.15e0) WHEN bl THEN 0.15e0 WHEN ce THEN ca ELSE a END + 1e-9, 5) AS frame_lo, round(CASE WHEN bx THEN least(0.85e0, g_x1 + 0.15e0) WHEN bl THEN 0.85e0 WHEN ce THEN cb ELSE b END + 1e-9, 5) AS frame_hi FROM d""")
def _(v):
    return T.framing_interval(v.frames.selectExpr(*FI), 0.3).select("match_id", "scene_id", "frame", "frame_lo", "frame_hi")


CT = ["match_id", "scene_id", "frame", "t_ms", "phase", "ball_x", "CASE WHEN k % 6 <> 5 THEN px END AS px", "CASE WHEN k % 6 <> 5 THEN px - 0.03e0 END AS px1", "CASE WHEN k % 6 <> 5 THEN px + 0.03e0 END AS px2", "(k % 21 - 10) / 16e0 AS velocity", "match_id % 2 = 0 AS goal_mode"]


@query("camera_target", f"""WITH c AS (SELECT {', '.join(CT)} FROM frames_v), r AS (SELECT *, least(ball_x, px1) AS l, greatest(ball_x, px2) AS g, ball_x * 0.72e0 + px * 0.28e0 + least(0.012e0, greatest(-0.012e0, velocity * 0.06e0)) AS b FROM c),
  s AS (SELECT *, CASE WHEN ball_x IS NULL THEN NULL WHEN phase IN ('setup', 'contact') THEN CASE WHEN px IS NOT NULL THEN least(1e0, greatest(0e0, CASE WHEN g - l + 2 * least(0.035e0, 0.316e0 * 0.11e0) <= 0.316e0 THEN least(l - least(0.035e0, 0.316e0 * 0.11e0) + 0.158e0, greatest(g + least(0.035e0, 0.316e0 * 0.11e0) - 0.158e0, b)) ELSE b END)) END
    ELSE least(1e0, greatest(0e0, ball_x + least(0.04e0, greatest(-0.04e0, velocity * CASE WHEN goal_mode THEN 0.14e0 ELSE 0.1e0 END)))) END AS raw FROM r)
  SELECT {KEYS}, frame, round(coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY t_ms), 0.5e0) + 1e-9, 5) AS target FROM s""")
def _(v):
    return T.camera_target(v.frames.selectExpr(*CT), 0.316).select("match_id", "scene_id", "frame", "target")


PK = ["match_id", "scene_id", "frame", "phase", "ball_x", "ball_y", "px", "px - 0.03e0 AS px1", "px + 0.03e0 AS px2", "ptop", "pbottom", "camera_x"]
PM = "CASE WHEN phase IN ('setup', 'contact') THEN 0.035e0 ELSE 0 END"
PIN = lambda x, y: f"coalesce(abs({x} - camera_x) <= 0.25e0 - {PM} AND abs({y} - 0.5e0) <= 0.5e0 - {PM}, false)"


@query("project_keyframes", f"""WITH k AS (SELECT {', '.join(PK)}, camera_x - 0.25e0 AS l FROM frames_v), o AS (SELECT *, {PIN('ball_x', 'ball_y')} AND {PIN('px1', 'ptop')} AND {PIN('px2', 'pbottom')} AS jn, CASE WHEN ball_x IS NOT NULL AND px1 IS NOT NULL THEN abs((least(ball_x, px1) + greatest(ball_x, px2)) / 2 - camera_x) / 0.25e0 ELSE 1e0 END AS off FROM k)
  SELECT {KEYS}, frame, round(coalesce((px - l) / 0.5e0 * 1080, -320) + 1e-9, 2) AS player_px, round(coalesce((ball_x - l) / 0.5e0 * 1080, -320) + 1e-9, 2) AS ball_px, round(coalesce(ball_y * 1920, -320) + 1e-9, 2) AS ball_py, round(coalesce(CASE WHEN px IS NOT NULL THEN least(px1 - l, l + 0.5e0 - px2) / 0.5e0 END, -1) + 1e-9, 5) AS player_room,
   round(coalesce(CASE WHEN ball_x IS NOT NULL THEN least(ball_x - l, l + 0.5e0 - ball_x) / 0.5e0 END, -1) + 1e-9, 5) AS ball_room, round(off + 1e-9, 5) AS offset, phase NOT IN ('setup', 'contact') OR coalesce(jn AND off <= 0.55e0 AND least(px1 - l, l + 0.5e0 - px2) / 0.5e0 >= 0.055e0, false) AS composition_safe FROM o""".replace("AS offset,", 'AS "offset",'))
def _(v):
    return T.project_keyframes(v.frames.selectExpr(*PK), 0.5)


OB = ["match_id", "scene_id", "frame", "phase", "CASE WHEN k % 7 = 0 THEN 'release' ELSE 'travel' END AS situation", "ball_x AS bx1", "ball_x + 0.01e0 AS bx2", "ball_y AS by1", "ball_y + 0.01e0 AS by2", "px - 0.04e0 AS px1", "px + 0.04e0 AS px2", "ptop AS py1", "pbottom AS py2"]


@query("observation_conflicts", f"""WITH o AS (SELECT {', '.join(OB)} FROM frames_v WHERE k % 23 <> 3 UNION ALL SELECT {', '.join(OB)} FROM frames_v WHERE k % 29 = 5), x AS (SELECT {KEYS}, frame FROM frames_v WHERE k % 31 <> 7), n AS (SELECT {KEYS}, frame, count(*) AS n FROM o GROUP BY ALL)
  SELECT DISTINCT {KEYS}, frame, 'touch_far_from_ball' AS issue FROM o WHERE (phase = 'contact' OR situation = 'release') AND sqrt(pow(greatest(0e0, px1 - bx2, bx1 - px2), 2) + pow(greatest(0e0, py1 - by2, by1 - py2), 2)) > 0.1e0 AND bx1 IS NOT NULL AND px1 IS NOT NULL
  UNION ALL SELECT * FROM (SELECT coalesce(x.match_id, n.match_id) AS match_id, coalesce(x.scene_id, n.scene_id) AS scene_id, coalesce(x.frame, n.frame) AS frame, CASE WHEN n IS NULL THEN 'missing_index' WHEN x.frame IS NULL THEN 'unexpected_index' WHEN n.n > 1 THEN 'repeated_index' END AS issue
    FROM x FULL JOIN n ON x.match_id = n.match_id AND x.scene_id = n.scene_id AND x.frame = n.frame) WHERE issue IS NOT NULL""")
def _(v):
    ok = v.frames.where("k % 23 <> 3").selectExpr(*OB).unionByName(v.frames.where("k % 29 = 5").selectExpr(*OB)).where("true")
    both = ok.withColumns(dict(bx1=F.when(F.col("px1").isNotNull(), F.col("bx1")), bx2=F.when(F.col("px1").isNotNull(), F.col("bx2"))))
    seen = both.withColumns({c: F.when(F.col("bx1").isNotNull(), F.col(c)) for c in ("px1", "px2", "py1", "py2", "by1", "by2")})
    return T.observation_conflicts(seen, v.frames.where("k % 31 <> 7").select("match_id", "scene_id", "frame"))


GP = [("100", "'setup'", "'runner waits'", "100e0", "150e0"), ("CASE WHEN ordinal % 7 = 0 THEN 50 ELSE 150 END", "CASE WHEN ordinal % 11 = 0 THEN 'odd' ELSE 'contact' END", "CASE WHEN ordinal % 5 = 0 THEN 'short' ELSE 'clean touch' END", "CASE WHEN ordinal % 9 = 0 THEN NULL ELSE 300e0 END", "CASE WHEN ordinal % 13 = 0 THEN 300e0 ELSE 380e0 END"),
      ("CASE WHEN ordinal % 3 = 0 THEN 200 ELSE 1500 END", "'payoff'", "'in the net'", "700e0", "CASE WHEN ordinal % 17 = 0 THEN 1200e0 ELSE 800e0 END")]


@query("guide_problems", """WITH g AS (SELECT moment_id, ordinal, end_ms - start_ms AS len, CASE WHEN ordinal % 7 = 0 THEN 50 ELSE 150 END AS t2, CASE WHEN ordinal % 3 = 0 THEN 200 ELSE 1500 END AS t3 FROM moments_v)
  SELECT moment_id, array_to_string([x FOR x IN [CASE WHEN t2 < 100 OR t3 < t2 OR t3 > len THEN 'anchor_clock' END, CASE WHEN ordinal % 11 = 0 THEN 'anchor_phase' END, CASE WHEN ordinal % 5 = 0 THEN 'anchor_text' END, CASE WHEN (ordinal % 13 = 0 AND ordinal % 9 <> 0) OR ordinal % 17 = 0 THEN 'anchor_box' END,
    CASE WHEN len >= 2000 AND ordinal % 9 <> 0 AND t3 - 100 < 125 THEN 'collapsed_clock' END] IF x IS NOT NULL], ',') AS problems FROM g""")
def _(v):
    rows = ", ".join(f"named_struct('t', CAST({t} AS BIGINT), 'phase', {p}, 'text', {x}, 'x1', {a}, 'x2', {b})" for t, p, x, a, b in GP)
    return T.guide_problems(v.moments.selectExpr("moment_id", "end_ms - start_ms AS length_ms", f"array({rows}) AS guide")).select("moment_id", "problems")


AO = ["match_id", "scene_id", "frame", "t_ms", "cut", "CASE WHEN frame % 6 IN (1, 2) AND k % 5 <> 0 THEN NULL ELSE 0.5e0 + (k % 10) / 128e0 END AS bx1", "CASE WHEN frame % 6 IN (1, 2) AND k % 5 <> 0 THEN NULL ELSE 0.51e0 + (k % 10) / 128e0 END AS bx2", "CASE WHEN k % 9 <> 8 THEN 0.45e0 + (k % 20) / 128e0 END AS px1", "CASE WHEN k % 9 <> 8 THEN 0.5e0 + (k % 20) / 128e0 END AS px2", "phase"]
AR = ["match_id", "scene_id", "i * 6 AS before", "i * 6 + 3 AS after"]


@query("attach_occlusions", f"""WITH o AS (SELECT {', '.join(AO)} FROM frames_v), r AS (SELECT {', '.join(AR)} FROM (SELECT DISTINCT {KEYS} FROM frames_v), (SELECT unnest(range(5)) AS i)), s AS (SELECT o.*, before, after, frame > before AND frame < after AS md FROM o JOIN r USING (match_id, scene_id) WHERE frame BETWEEN before AND after),
  g AS (SELECT {KEYS}, before, after, count(*) FILTER (NOT md AND bx1 IS NOT NULL) AS ends, max(t_ms) - min(t_ms) AS gap, count(*) FILTER (frame > before AND cut) AS cuts, count(*) FILTER (md) AS n, count(*) FILTER (md AND bx1 IS NULL AND px1 IS NOT NULL AND phase IN ('flight', 'contact')) AS ok, min(CASE WHEN md THEN px1 ELSE bx1 END) AS l, max(CASE WHEN md THEN px2 ELSE bx2 END) AS rr FROM s GROUP BY ALL)
  SELECT {KEYS}, unnest(range(before + 1, after)) AS frame, round(l + 1e-9, 5) AS "left", round(rr + 1e-9, 5) AS "right" FROM g WHERE ends = 2 AND gap <= 1000 AND cuts = 0 AND n > 0 AND n = ok AND rr - l <= 0.316e0""")
def _(v):
    rev = v.frames.select("match_id", "scene_id").distinct().selectExpr("match_id", "scene_id", "explode(sequence(0L, 4L)) AS i").selectExpr(*AR)
    return T.attach_occlusions(v.frames.selectExpr(*AO), rev, 0.316)


@query("greedy_ball")
def _(v):
    return T.greedy_ball(v.frames, v.balls.withColumn("near", F.expr("(ordinal % 40) / 128e0")))


@query("hold_pan_path")
def _(v):
    return T.hold_pan_path(v.frames.selectExpr(*NB, "target_x"))


@query("tracked_path")
def _(v):
    return T.tracked_path(v.frames.selectExpr(*NB, "target_x"))


SMO = "CASE WHEN phase IN ('setup', 'contact') THEN 'carrier' ELSE 'ball' END"


@query("smooth_path", f"""WITH RECURSIVE {SH_SQL}, l AS (SELECT *, {SMO} AS own, row_number() OVER w AS rn, lead(target_x, 1) OVER w AS x1, lead(target_x, 2) OVER w AS x2, lead({SMO}, 1) OVER w AS o1, lead({SMO}, 2) OVER w AS o2 FROM sh WINDOW w AS (PARTITION BY {KEYS}, shot ORDER BY t_ms)),
  a AS MATERIALIZED (SELECT *, target_x * 0.92e0 + CASE WHEN o1 = own AND o2 = own THEN x2 WHEN o1 = own THEN x1 ELSE target_x END * 0.08e0 AS aim FROM l),
  w AS (SELECT match_id, scene_id, shot, rn, frame, t_ms, least(0.842e0, greatest(0.158e0, aim)) AS x FROM a WHERE rn = 1 UNION ALL SELECT match_id, scene_id, shot, rn, frame, t_ms, least(0.842e0, greatest(0.158e0, px + least(cap, greatest(-cap, g * least(0.32e0, greatest(0.1e0, 0.1e0 + abs(g) * 0.58e0)))))) FROM
    (SELECT a.match_id, a.scene_id, a.shot, a.rn, a.frame, a.t_ms, w.x AS px, greatest(0.001e0, (a.t_ms - w.t_ms) / 1000) * 0.42e0 AS cap, CASE WHEN abs(a.aim - w.x) < 0.004e0 THEN 0e0 ELSE a.aim - w.x END AS g FROM w JOIN a ON a.match_id = w.match_id AND a.scene_id = w.scene_id AND a.shot = w.shot AND a.rn = w.rn + 1))
  SELECT {KEYS}, frame, round(coalesce((lag(x, 2) OVER f + lag(x, 1) OVER f * 2 + x * 3 + lead(x, 1) OVER f * 2 + lead(x, 2) OVER f) / 9, x) + 1e-9, 5) AS camera_x FROM w WINDOW f AS (PARTITION BY {KEYS}, shot ORDER BY frame)""")
def _(v):
    return T.smooth_path(v.frames, 0.158)
