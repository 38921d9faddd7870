"""Queries over ball, player and camera time series of bounded scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import tracks as T
from matchspark.plans.registry import query

SH_SQL = "sh AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, scene_id ORDER BY t_ms) AS BIGINT) AS shot FROM frames_v)"
ENDS_SQL = SH_SQL + """, en AS (SELECT *, last_value(CASE WHEN ball_x IS NOT NULL THEN struct_pack(t := t_ms, x := ball_x, y := ball_y) END IGNORE NULLS) OVER (PARTITION BY match_id, scene_id, shot ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
   first_value(CASE WHEN ball_x IS NOT NULL THEN struct_pack(t := t_ms, x := ball_x, y := ball_y) END IGNORE NULLS) OVER (PARTITION BY match_id, scene_id, shot ORDER BY t_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM sh),
 li AS (SELECT *, q.t - p.t AS gap, (t_ms - p.t) / (q.t - p.t) AS a FROM en WHERE ball_x IS NULL)"""
KEYS = "match_id, scene_id"


@query("fill_gaps", f"WITH {ENDS_SQL} SELECT {KEYS}, frame, round(p.x * (1 - a) + q.x * a + 1e-9, 5) AS guide_x, round(p.y * (1 - a) + q.y * a + 1e-9, 5) AS guide_y FROM li WHERE gap <= 450")
def _(v):
    return T.fill_gaps(v.frames)


GUIDE_SQL = f"""{ENDS_SQL}, gu AS (SELECT {KEYS}, frame, CASE WHEN gap <= 750 THEN round(p.x * (1 - a) + q.x * a + 1e-9, 5) WHEN p IS NULL AND q.t - t_ms <= 3000 THEN round(q.x + 1e-9, 5) WHEN q IS NULL AND t_ms - p.t <= 550 THEN round(p.x + 1e-9, 5) END AS guide_x,
   CASE WHEN gap <= 750 THEN round(p.y * (1 - a) + q.y * a + 1e-9, 5) WHEN p IS NULL AND q.t - t_ms <= 3000 THEN round(q.y + 1e-9, 5) WHEN q IS NULL AND t_ms - p.t <= 550 THEN round(p.y + 1e-9, 5) END AS guide_y FROM li)"""


@query("guidance", f"WITH {GUIDE_SQL} SELECT * FROM gu WHERE guide_x IS NOT NULL")
def _(v):
    return T.guidance(v.frames)


OL = ["match_id", "scene_id", "t_ms", "direct", "track_id", "(ordinal % 40) / 256e0 AS touch", "1400 AS contact_ms"]


@query("origin_lock", f"""WITH o AS (SELECT {', '.join(OL)} FROM frames_v), k AS (SELECT *, lag(track_id) OVER (PARTITION BY {KEYS} ORDER BY t_ms) = track_id AS again FROM o WHERE direct AND track_id IS NOT NULL AND touch <= 0.13e0 AND t_ms <= 2150)
  SELECT {KEYS}, arg_min(track_id, t_ms) AS origin_id, min(t_ms) AS lock_ms FROM k WHERE again GROUP BY ALL""")
def _(v):
    return T.origin_lock(v.frames.selectExpr(*OL))


@query("identity_switches", f"""WITH k AS (SELECT *, track_id <> lag(track_id) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS swap FROM frames_v WHERE track_id IS NOT NULL), s AS (SELECT {KEYS}, count(*) FILTER (swap) AS switches FROM k GROUP BY ALL)
  SELECT {KEYS}, coalesce(switches, 0) AS switches FROM (SELECT DISTINCT {KEYS} FROM frames_v) LEFT JOIN s USING ({KEYS})""")
def _(v):
    return T.identity_switches(v.frames)


SCP = ["match_id", "scene_id", "frame", "idx", "CASE WHEN ordinal % 3 = 0 AND idx > 1 THEN 0.1e0 ELSE 0.9e0 END AS confidence", "0.1e0 AS y1", "0.1e0 + CASE WHEN ordinal % 3 = 0 THEN 0.35e0 + (ordinal % 5) / 16e0 - idx * 0.2e0 * (ordinal % 2) ELSE 0.12e0 + (idx + ordinal) % 4 / 32e0 END AS y2"]


@query("scale_cuts", f"""WITH {SH_SQL}, p AS (SELECT {KEYS}, frame, list_sort(list(y2 - y1)) AS h FROM (SELECT {', '.join(SCP)} FROM players_v) WHERE confidence >= 0.45e0 GROUP BY ALL),
  f AS (SELECT sh.*, coalesce(h[len(h)] > 0.55e0 AND (len(h) = 1 OR h[len(h) - 1] < h[len(h)] * 0.4e0), false) AS fg, coalesce(len(h) >= 3 AND h[len(h) // 2 + 1] < 0.25e0 AND h[len(h)] < 0.4e0, false) AS av, coalesce(len(h) <= 2 AND h[len(h) // 2 + 1] > 0.3e0, false) AS cu, coalesce(len(h) >= 4 AND h[len(h) // 2 + 1] < 0.18e0, false) AS wd FROM sh LEFT JOIN p USING (match_id, scene_id, frame))
  SELECT a.match_id, a.scene_id, a.frame, coalesce(bool_or((a.fg AND b.av) OR (a.av AND b.fg) OR (a.cu AND b.wd) OR (a.wd AND b.cu)), false) AS scale_cut FROM f a LEFT JOIN f b ON a.match_id = b.match_id AND a.scene_id = b.scene_id AND b.t_ms < a.t_ms AND a.t_ms - b.t_ms <= 650 AND b.shot = a.shot - CASE WHEN a.cut THEN 1 ELSE 0 END GROUP BY ALL""")
def _(v):
    return T.scale_cuts(v.frames, v.players.selectExpr(*SCP))


RHB = ["match_id", "scene_id", "frame", "t_ms", "idx", "confidence", "pitch_support", "cx", "cy", "cx - 0.004e0 AS x1", "cx + 0.004e0 + (ordinal % 5) / 256e0 AS x2", "cy - 0.01e0 AS y1", "cy + 0.01e0 AS y2"]


@query("reacquire_hint", f"""WITH s AS (SELECT *, last_value(CASE WHEN ball_x IS NOT NULL THEN struct_pack(t := t_ms, x := ball_x, y := ball_y) END IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM frames_v),
  b AS (SELECT {', '.join(RHB)} FROM balls_v), j AS (SELECT b.match_id, b.scene_id, b.frame, b.idx FROM b JOIN s USING (match_id, scene_id, frame) WHERE s.t_ms - s.t <= 750 AND confidence >= 0.04e0 AND b.pitch_support >= 0.1e0 AND x2 - x1 > 0 AND x2 - x1 <= 0.02e0 AND y2 - y1 <= 0.035e0 AND cy BETWEEN 0.12e0 AND 0.97e0
    AND sqrt(pow(cx - s.x, 2) + pow((cy - s.y) * 0.6e0, 2)) <= 0.025e0 + 0.9e0 * (s.t_ms - s.t) / 1000)
  SELECT match_id, scene_id, frame, min(idx) AS idx FROM j GROUP BY ALL HAVING count(*) = 1""".replace("s.t_ms - s.t <=", "s.t_ms - s.s.t <=").replace("cx - s.x", "cx - s.s.x").replace("cy - s.y", "cy - s.s.y").replace("(s.t_ms - s.t) /", "(s.t_ms - s.s.t) /"))
def _(v):
    return T.reacquire_hint(v.frames, v.balls.selectExpr(*RHB))


SCR = ["match_id", "scene_id", "scene_id % 9 AS scorer_id", "1500 AS contact_ms"]


@query("backfill_scorer", f"""WITH sc AS (SELECT {', '.join(SCR)} FROM (SELECT DISTINCT {KEYS} FROM frames_v)), m AS (SELECT {KEYS}, frame, track_id, min(struct_pack(cx := cx, x1 := x1, x2 := x2, y1 := y1, y2 := y2)) AS m FROM players_v GROUP BY ALL),
  j AS (SELECT f.*, scorer_id, contact_ms, m.m.cx AS cx, m.m.x1 AS x1, m.m.x2 AS x2, m.m.y1 AS y1, m.m.y2 AS y2 FROM frames_v f JOIN sc USING (match_id, scene_id) LEFT JOIN m ON m.match_id = f.match_id AND m.scene_id = f.scene_id AND m.frame = f.frame AND m.track_id = scorer_id),
  d AS (SELECT *, coalesce(phase IN ('setup', 'contact') AND t_ms <= 1750 AND CASE WHEN ball_x BETWEEN x1 - 0.012e0 AND x2 + 0.012e0 AND ball_y BETWEEN y1 - 0.025e0 AND y1 + (y2 - y1) * 0.18e0 THEN least(sqrt(pow(cx - ball_x, 2) + pow((y2 - ball_y) * 0.52e0, 2)), sqrt(pow(cx - ball_x, 2) + pow((y1 + (y2 - y1) * 0.08e0 - ball_y) * 0.52e0, 2)))
     ELSE sqrt(pow(cx - ball_x, 2) + pow((y2 - ball_y) * 0.52e0, 2)) END <= 0.13e0, false) AS ok FROM j)
  SELECT {KEYS}, frame, CASE WHEN ok THEN scorer_id ELSE track_id END AS track_id, ok AS replaced, round(CASE WHEN ok THEN ball_x * 0.72e0 + cx * 0.28e0 ELSE target_x END + 1e-9, 5) AS target_x FROM d""")
def _(v):
    scorers = v.frames.select("match_id", "scene_id").distinct().selectExpr(*SCR)
    return T.backfill_scorer(v.frames, v.players, scorers)


@query("stable_targets", f"""WITH {SH_SQL}, g AS (SELECT {KEYS}, shot, phase, max(lo / 4 + 0.2e0) AS l, min(hi / 2 + 0.3e0) AS h, median(target_x) AS m FROM sh WHERE phase IN ('setup', 'contact') AND joint_fit GROUP BY ALL)
  SELECT sh.match_id, sh.scene_id, frame, round(coalesce(CASE WHEN l <= h THEN greatest(l, least(h, m)) END, target_x) + 1e-9, 5) AS target_x, coalesce(l <= h, false) AS held FROM sh LEFT JOIN g ON g.match_id = sh.match_id AND g.scene_id = sh.scene_id AND g.shot = sh.shot AND g.phase = sh.phase""")
def _(v):
    return T.stable_targets(v.frames.withColumns(dict(lo=F.expr("lo / 4 + 0.2e0"), hi=F.expr("hi / 2 + 0.3e0"))))


CB = ["match_id", "scene_id", "frame", "t_ms", "cut", "direct", "ball_x", "CASE WHEN ordinal % 4 = 0 THEN 0.125e0 ELSE lo END AS lo", "CASE WHEN ordinal % 4 = 0 THEN 0.875e0 ELSE hi END AS hi"]


@query("carry_bounds", f"""WITH r AS (SELECT {', '.join(CB)} FROM frames_v), sh AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS shot FROM r),
  e AS (SELECT *, last_value(CASE WHEN direct THEN struct_pack(t := t_ms, x := ball_x) END IGNORE NULLS) OVER (PARTITION BY {KEYS}, shot ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(CASE WHEN direct THEN struct_pack(t := t_ms, x := ball_x) END IGNORE NULLS) OVER (PARTITION BY {KEYS}, shot ORDER BY t_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM sh),
  f AS (SELECT *, coalesce(NOT direct AND q.t - p.t <= 1250 AND abs(q.x - p.x) > 0.25e0 * 0.4e0, false) AS fr FROM e), g AS (SELECT *, sum(CASE WHEN fr THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS}, shot ORDER BY t_ms) AS leg, NOT fr AND (lo <> 0.125e0 OR hi <> 0.875e0) AS bd FROM f),
  h AS (SELECT *, last_value(CASE WHEN bd THEN struct_pack(t := t_ms, l := lo, h := hi) END IGNORE NULLS) OVER (PARTITION BY {KEYS}, shot, leg ORDER BY t_ms) AS held FROM g)
  SELECT {KEYS}, frame, CASE WHEN bd THEN lo WHEN NOT fr AND t_ms - held.t <= 650 THEN held.l ELSE 0.125e0 END AS lo, CASE WHEN bd THEN hi WHEN NOT fr AND t_ms - held.t <= 650 THEN held.h ELSE 0.875e0 END AS hi, fr AS released FROM h""")
def _(v):
    return T.carry_bounds(v.frames.selectExpr(*CB), 0.25)


NB = ["match_id", "scene_id", "frame", "t_ms", "cut", "phase", "ball_x", "0.3e0 + lo / 4 AS lo", "0.38e0 + lo / 4 + hi / 8 AS hi"]
NB_SQL = f"nb0 AS (SELECT {', '.join(NB)} FROM frames_v), nb AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS BIGINT) AS shot FROM nb0)"
REACH = lambda v_: f"(SELECT a.*, (SELECT max(b.lo - {v_} * (b.t_ms - a.t_ms) / 1000) FROM nb b WHERE b.match_id = a.match_id AND b.scene_id = a.scene_id AND b.shot = a.shot AND b.t_ms >= a.t_ms) AS rl, (SELECT min(b.hi + {v_} * (b.t_ms - a.t_ms) / 1000) FROM nb b WHERE b.match_id = a.match_id AND b.scene_id = a.scene_id AND b.shot = a.shot AND b.t_ms >= a.t_ms) AS rh FROM nb a)"


def bounds(v):
    return T.with_shot(v.frames.selectExpr(*NB))


@query("reachable_bounds", f"WITH {NB_SQL} SELECT {KEYS}, frame, round(rl + 1e-9, 5) AS reach_lo, round(rh + 1e-9, 5) AS reach_hi, rl <= rh + 1e-9 AS feasible FROM {REACH('0.35e0')}")
def _(v):
    return T.reachable_bounds(bounds(v), 0.35).select("match_id", "scene_id", "frame", T.r5("reach_lo").alias("reach_lo"), T.r5("reach_hi").alias("reach_hi"), "feasible")


@query("lazy_path", f"""WITH RECURSIVE {NB_SQL}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {KEYS}, shot ORDER BY t_ms) AS rn FROM {REACH('0.35e0')}),
  w AS (SELECT match_id, scene_id, shot, rn, frame, t_ms, (rl + rh) / 2 AS x FROM r WHERE rn = 1 UNION ALL SELECT r.match_id, r.scene_id, r.shot, r.rn, r.frame, r.t_ms, least(least(r.rh, w.x + (r.t_ms - w.t_ms) * 0.35e0 / 1000), greatest(greatest(r.rl, w.x - (r.t_ms - w.t_ms) * 0.35e0 / 1000), w.x))
    FROM w JOIN r ON r.match_id = w.match_id AND r.scene_id = w.scene_id AND r.shot = w.shot AND r.rn = w.rn + 1) SELECT {KEYS}, frame, round(x + 1e-9, 5) AS camera_x FROM w""")
def _(v):
    return T.lazy_path(bounds(v), 0.35)


@query("shot_speed", f"""WITH {NB_SQL}, f AS ({' UNION ALL '.join(f"SELECT {KEYS}, shot, '{n}' AS tier, bool_and(rl <= rh + 1e-9) AS ok FROM {REACH(sp)} GROUP BY ALL" for n, sp in (('a', '0.22e0'), ('b', '0.35e0'), ('c', '1.5e0'), ('d', '3e0')))}),
  p AS (SELECT *, phase = 'flight' AND lag(phase) OVER w = 'flight' AND ball_x IS NOT NULL AND lag(ball_x) OVER w IS NOT NULL AS pr FROM nb WINDOW w AS (PARTITION BY {KEYS}, shot ORDER BY t_ms)), g AS (SELECT {KEYS}, shot, max(lo) <= min(hi) AS fx, count(*) FILTER (pr) AS n FROM p GROUP BY ALL),
  t AS (SELECT {KEYS}, shot, bool_or(ok) FILTER (tier = 'a') AS a, bool_or(ok) FILTER (tier = 'b') AS b, bool_or(ok) FILTER (tier = 'c') AS c, bool_or(ok) FILTER (tier = 'd') AS d FROM f GROUP BY ALL)
  SELECT match_id, scene_id, shot, CASE WHEN fx THEN 'fixed' WHEN a THEN 'calm' WHEN b THEN 'normal' WHEN n < 2 THEN 'infeasible' WHEN c THEN 'flight' WHEN d THEN 'handoff' ELSE 'infeasible' END AS tier FROM g JOIN t USING (match_id, scene_id, shot)""")
def _(v):
    return T.shot_speed(bounds(v))


EMA = ["match_id", "scene_id", "frame", "t_ms", "direct", "ball_x", "CASE WHEN k % 3 <> 0 THEN k / 128e0 END AS guide_x"]


@query("ema_velocity", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS rn FROM (SELECT {', '.join(EMA)} FROM frames_v)),
  w AS (SELECT match_id, scene_id, 0::BIGINT AS rn, 0e0 AS v, NULL::DOUBLE AS x, 0::BIGINT AS t, NULL::BIGINT AS frame FROM (SELECT DISTINCT {KEYS} FROM e) UNION ALL
   SELECT e.match_id, e.scene_id, e.rn, CASE WHEN direct THEN CASE WHEN w.x IS NULL THEN w.v ELSE least(1.1e0, greatest(-1.1e0, w.v * 0.6e0 + (ball_x - w.x) / greatest(0.001e0, (t_ms - w.t) / 1000) * 0.4e0)) END WHEN guide_x IS NOT NULL THEN w.v * 0.76e0 ELSE 0 END, CASE WHEN direct THEN ball_x ELSE guide_x END, t_ms, e.frame
   FROM w JOIN e ON e.match_id = w.match_id AND e.scene_id = w.scene_id AND e.rn = w.rn + 1) SELECT {KEYS}, frame, round(v + 1e-9, 5) AS velocity FROM w WHERE rn > 0""")
def _(v):
    return T.ema_velocity(v.frames.selectExpr(*EMA))


HC = ["match_id", "scene_id", "frame", "t_ms", "cut", "camera_x", "CASE WHEN phase = 'flight' THEN 'ball' ELSE 'carrier' END AS owner", "direct AS has_ball"]


@query("handoff_cuts", f"""WITH h AS (SELECT {', '.join(HC)} FROM frames_v), l AS (SELECT *, lag(camera_x) OVER w AS px, lag(t_ms) OVER w AS pt, lag(owner) OVER w AS po, lag(has_ball) OVER w AS pb FROM h WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms))
  SELECT {KEYS}, frame, pt IS NOT NULL AND (cut OR (t_ms - pt <= 260 AND (abs(camera_x - px) >= 0.28e0 OR (abs(camera_x - px) >= 0.14e0 AND (owner <> po OR has_ball <> pb))))) AS handoff_cut FROM l""")
def _(v):
    return T.handoff_cuts(v.frames.selectExpr(*HC))


MR = ["match_id", "scene_id", "frame", "t_ms", "subject_confidence", "k % 7 <> 0 AS eligible", "CASE WHEN k % 29 <> 1 THEN CAST(floor(frame / 7) AS BIGINT) END AS track_id"]
MR_SQL = f"""mr AS (SELECT {', '.join(MR)} FROM frames_v), ok AS (SELECT *, eligible AND track_id IS NOT NULL AS ok FROM mr), tn AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w AND lag(track_id) OVER w = track_id THEN 0 ELSE 1 END AS tn FROM ok WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms)),
 rn AS (SELECT *, sum(tn) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS rn FROM tn), vs AS (SELECT *, ok AND count(*) OVER (PARTITION BY {KEYS}, rn) >= 3 AS visible FROM rn)"""


@query("marker_runs", f"WITH {MR_SQL} SELECT {KEYS}, frame, t_ms, subject_confidence, visible FROM vs")
def _(v):
    return T.marker_runs(v.frames.selectExpr(*MR))


@query("overlay_span", f"WITH {MR_SQL}, g AS (SELECT {KEYS}, min(t_ms) AS a, max(t_ms) AS b, list_sort(list(subject_confidence)) AS c FROM vs WHERE visible GROUP BY ALL) SELECT {KEYS}, a AS start_ms, greatest(a + 100, b + 120) AS end_ms, c[len(c) // 2 + 1] AS confidence FROM g")
def _(v):
    return T.overlay_span(v.frames.selectExpr(*MR))


@query("payoff_run", f"""WITH k AS (SELECT *, k % 6 <> 0 AS valid FROM frames_v), b AS (SELECT *, valid AND (NOT coalesce(lag(valid) OVER w, false) OR cut OR t_ms - lag(t_ms) OVER w > 160) AS br FROM k WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms)),
  l AS (SELECT *, sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS leg FROM b), f AS (SELECT *, min(t_ms) OVER (PARTITION BY {KEYS}, leg) AS a FROM l WHERE valid)
  SELECT {KEYS}, arg_min(a, t_ms) AS start_ms, min(t_ms) AS end_ms FROM f WHERE t_ms - a >= 500 GROUP BY ALL""")
def _(v):
    return T.payoff_run(v.frames.withColumn("valid", F.expr("k % 6 <> 0")))


@query("bracketed_gap", f"WITH {ENDS_SQL} SELECT {KEYS}, frame, coalesce(gap <= 400, false) AS bracketed FROM li")
def _(v):
    return T.bracketed_gap(v.frames)


SPK = ["match_id", "scene_id", "frame", "t_ms", "cut", "CASE WHEN k % 3 = 0 THEN 'travel' ELSE 'possession' END AS situation", "0.5e0 + CASE WHEN frame % 4 = 2 THEN (k % 40) / 64e0 ELSE (k % 5) / 128e0 END AS ball_x", "0.5e0 AS ball_y"]


@query("spike_rows", f"""WITH s AS (SELECT {', '.join(SPK)} FROM frames_v), l AS (SELECT *, lag(ball_x) OVER w AS a, lead(ball_x) OVER w AS c, lead(cut) OVER w AS nc FROM s WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms))
  SELECT {KEYS}, frame FROM l WHERE NOT cut AND NOT nc AND situation = 'possession' AND abs(a - c) < 0.08e0 AND abs(a - ball_x) > 0.12e0 AND abs(ball_x - c) > 0.12e0""")
def _(v):
    return T.spike_rows(v.frames.selectExpr(*SPK))


@query("recheck_rows", f"""WITH t AS (SELECT {KEYS}, frame FROM frames_v WHERE k % 5 = 0), c AS (SELECT {KEYS}, frame, 0 AS p, frame AS src FROM t UNION ALL SELECT {KEYS}, frame - 1, 1, frame FROM t UNION ALL SELECT {KEYS}, frame + 1, 1, frame FROM t),
  o AS (SELECT c.match_id, c.scene_id, c.frame, min(struct_pack(p := p, s := src, f := c.frame)) AS o FROM c JOIN frames_v USING (match_id, scene_id, frame) GROUP BY ALL) SELECT {KEYS}, frame FROM o QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY o) <= 6""")
def _(v):
    return T.recheck_rows(v.frames, v.frames.where("k % 5 = 0"), 6)


LT = ["match_id", "scene_id", "frame", "t_ms", "cut AND frame % 5 = 0 AS cut", "CASE WHEN frame < 9 + scene_id % 5 THEN 'setup' WHEN frame < 14 THEN 'contact' ELSE 'flight' END AS phase", "'possession' AS situation", "0.5e0 AS ball_x1", "0.52e0 AS ball_x2",
      "0.5e0 + CASE WHEN frame < match_id % 6 THEN 0.4e0 WHEN k % 37 = 1 THEN 0.35e0 ELSE 0.05e0 END AS px1", "0.56e0 + CASE WHEN frame < match_id % 6 THEN 0.4e0 WHEN k % 37 = 1 THEN 0.35e0 ELSE 0.05e0 END AS px2"]


@query("lead_in_trim", f"""WITH l AS (SELECT {', '.join(LT)} FROM frames_v), f AS (SELECT *, greatest(ball_x2, px2) - least(ball_x1, px1) <= 0.316e0 AS fits, min(t_ms) FILTER (phase = 'contact') OVER (PARTITION BY {KEYS}) AS tm, row_number() OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS rn FROM l),
  g AS (SELECT {KEYS}, min(t_ms) AS t0, max(tm) AS tm, coalesce(bool_and(phase = 'setup' AND (NOT cut OR rn = 1)) FILTER (t_ms < tm), false) AS cl, min(t_ms) FILTER (t_ms < tm AND fits) AS off, max(t_ms) FILTER (t_ms <= tm AND NOT fits) AS bad FROM f GROUP BY ALL)
  SELECT {KEYS}, off AS offset_ms FROM g WHERE cl AND tm > t0 AND tm <= 4000 AND off > t0 AND off <= 3500 AND tm - off >= 100 AND bad < off""")
def _(v):
    return T.lead_in_trim(v.frames.selectExpr(*LT), 0.316)


WANT = ["match_id", "scene_id", "1000 + 37 * (match_id % 20) AS want_ms"]
WANT_SQL = f"wt AS (SELECT {', '.join(WANT)} FROM (SELECT DISTINCT {KEYS} FROM frames_v))"


@query("freeze_anchor", f"""WITH {WANT_SQL}, r AS (SELECT *, direct AND lead(direct, 1) OVER w AND lead(direct, 2) OVER w AND NOT lead(cut, 1) OVER w AND NOT lead(cut, 2) OVER w AND joint_fit AND subject_confidence * 2 >= 0.85e0 AS ok FROM frames_v WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms))
  SELECT match_id, scene_id, arg_min(t_ms, struct_pack(d := abs(t_ms - want_ms), t := t_ms)) AS anchor_ms FROM r JOIN wt USING (match_id, scene_id) WHERE ok AND abs(t_ms - want_ms) <= 150 GROUP BY ALL""")
def _(v):
    return T.freeze_anchor(v.frames.withColumn("subject_confidence", F.col("subject_confidence") * 2), v.frames.select("match_id", "scene_id").distinct().selectExpr(*WANT))


@query("opening_lock", f"""WITH h AS (SELECT *, count(*) FILTER (direct AND joint_fit) OVER w AS s, count(*) OVER w AS n FROM frames_v WHERE t_ms <= 1050 WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT {KEYS}, bool_or(s >= 3 AND n = 5) AS opening FROM h GROUP BY ALL""")
def _(v):
    return T.opening_lock(v.frames)


ANC = ["match_id", "scene_id", "100 * (match_id % 12) AS anchor_ms"]


@query("motion_path", f"""WITH an AS (SELECT {', '.join(ANC)} FROM (SELECT DISTINCT {KEYS} FROM frames_v)), r AS (SELECT f.*, bool_and(direct AND (NOT cut OR t_ms = anchor_ms)) OVER (PARTITION BY f.match_id, f.scene_id ORDER BY t_ms) AS run FROM frames_v f JOIN an USING (match_id, scene_id) WHERE t_ms BETWEEN anchor_ms AND anchor_ms + 600)
  SELECT {KEYS}, frame, ball_x, ball_y FROM r WHERE run QUALIFY count(*) OVER (PARTITION BY {KEYS}) >= 3""")
def _(v):
    return T.motion_path(v.frames, v.frames.select("match_id", "scene_id").distinct().selectExpr(*ANC))


PE = ["match_id", "scene_id", "frame", "t_ms", "cut", "k % 6 <> 0 AS possession", "k % 11 <> 0 AS direct", "0.75e0 AS subject_confidence", "CAST(floor((frame + match_id % 3) / 5) AS BIGINT) % 3 AS track_id"]


@query("pass_events", f"""WITH e AS (SELECT {', '.join(PE)} FROM frames_v), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS shot, possession AND direct AS hold FROM e),
  t AS (SELECT *, CASE WHEN hold AND lag(hold) OVER w AND lag(track_id) OVER w = track_id THEN 0 ELSE 1 END AS tn FROM s WINDOW w AS (PARTITION BY {KEYS}, shot ORDER BY t_ms)), l AS (SELECT *, sum(tn) OVER (PARTITION BY {KEYS}, shot ORDER BY t_ms) AS leg FROM t),
  r AS (SELECT {KEYS}, shot, leg, track_id, count(*) AS n, min(t_ms) AS a, max(t_ms) AS b FROM l WHERE hold GROUP BY ALL), q AS (SELECT *, lag(track_id) OVER w AS fi, lag(b) OVER w AS fm FROM r WINDOW w AS (PARTITION BY {KEYS}, shot ORDER BY a))
  SELECT {KEYS}, fi AS from_id, track_id AS to_id, fm AS from_ms, a AS to_ms FROM q WHERE n >= 3 AND fi <> track_id AND a - fm <= 5000""")
def _(v):
    return T.pass_events(v.frames.selectExpr(*PE))


@query("pass_network_run", f"""WITH u AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER (PARTITION BY {KEYS} ORDER BY t_ms) > 240, true) AS tn FROM frames_v WHERE k % 5 > 1), l AS (SELECT *, sum(CASE WHEN tn THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY t_ms) AS leg FROM u),
  g AS (SELECT {KEYS}, leg, count(*) AS n, min(t_ms) AS a, max(t_ms) AS b FROM l GROUP BY ALL) SELECT {KEYS}, a AS start_ms, b AS end_ms, n AS samples FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY leg DESC) = 1) WHERE n >= 6 AND b - a >= 360""")
def _(v):
    return T.pass_network_run(v.frames.withColumn("usable", F.expr("k % 5 > 1")))


@query("resample", f"""WITH o AS (SELECT {KEYS}, t_ms, ball_x, lead(t_ms) OVER w AS nt, lead(ball_x) OVER w AS nx, min(t_ms) OVER (PARTITION BY {KEYS}) AS t0 FROM frames_v WHERE ball_x IS NOT NULL WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms)),
  g AS (SELECT o.match_id, o.scene_id, t0 + i * 50 AS tt, ball_x * (1 - coalesce((t0 + i * 50 - t_ms) / (nt - t_ms), 0)) + coalesce(nx, ball_x) * coalesce((t0 + i * 50 - t_ms) / (nt - t_ms), 0) AS x FROM o, (SELECT unnest(range(70)) AS i) WHERE t0 + i * 50 >= t_ms AND t0 + i * 50 <= coalesce(nt - 1, t_ms))
  SELECT {KEYS}, tt AS t_ms, round(median(x) OVER (PARTITION BY {KEYS} ORDER BY tt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 1e-9, 5) AS x FROM g""")
def _(v):
    return T.resample(v.frames)


AN2 = ["match_id", "scene_id", "t_ms + 13 AS a_ms", "(k % 50) / 64e0 AS a_x"]


@query("search_regions", f"""WITH a AS (SELECT {', '.join(AN2)} FROM frames_v WHERE k % 9 = 4), f AS (SELECT * FROM frames_v),
  j AS (SELECT f.match_id, f.scene_id, f.frame, f.t_ms, (SELECT max(struct_pack(t := a_ms, x := a_x)) FROM a WHERE a.match_id = f.match_id AND a.scene_id = f.scene_id AND a_ms < f.t_ms) AS p, (SELECT min(struct_pack(t := a_ms, x := a_x)) FROM a WHERE a.match_id = f.match_id AND a.scene_id = f.scene_id AND a_ms > f.t_ms) AS q FROM f),
  c AS (SELECT *, EXISTS (SELECT 1 FROM frames_v z WHERE z.match_id = j.match_id AND z.scene_id = j.scene_id AND z.cut AND z.t_ms > p.t AND z.t_ms <= q.t) AS ct, t_ms - p.t AS dp, q.t - t_ms AS dq FROM j),
  r AS (SELECT *, coalesce(dp <= 200 AND (dq IS NULL OR dp <= dq), false) AS up, coalesce(dq <= 200, false) AS uq, coalesce(NOT ct AND dp + dq <= 4000, false) AS md FROM c)
  SELECT {KEYS}, frame, round(CASE WHEN up THEN p.x WHEN uq THEN q.x ELSE p.x * (1 - dp / (dp + dq)) + q.x * dp / (dp + dq) END + 1e-9, 5) AS x, round(CASE WHEN up THEN 0.025e0 + dp * 0.00035e0 WHEN uq THEN 0.025e0 + dq * 0.00035e0 ELSE least(0.1e0, 0.025e0 + least(dp, dq) * 0.00012e0) END + 1e-9, 5) AS radius, up OR uq AS observed FROM r WHERE up OR uq OR md""")
def _(v):
    return T.search_regions(v.frames, v.frames.where("k % 9 = 4").selectExpr(*AN2))


@query("camera_owner", f"SELECT {KEYS}, frame, CASE WHEN joint_fit AND (phase IN ('setup', 'contact') OR possession) THEN 'carrier' WHEN phase IN ('setup', 'contact') THEN 'hold' WHEN direct THEN 'ball' WHEN phase = 'payoff' THEN 'payoff' ELSE 'hold' END AS owner FROM frames_v")
def _(v):
    return T.camera_owner(v.frames.withColumns(dict(joint_visible=F.col("joint_fit"), tracked_ball=F.col("direct")))).select("match_id", "scene_id", "frame", "owner")


SCF = ["match_id", "scene_id", "frame", "direct", "ball_confidence", "target_x AS confidence", "CASE WHEN k % 5 <> 0 THEN (ordinal % 60) / 256e0 END AS touch", "CASE WHEN k % 7 <> 0 THEN ordinal % 9 END AS track_age"]


@query("subject_confidence", f"""WITH s AS (SELECT {', '.join(SCF)} FROM frames_v) SELECT {KEYS}, frame, round(least(1e0, confidence * 0.3e0 + greatest(0, 1 - coalesce(touch, 0.5e0) / 0.2e0) * 0.28e0 + least(1e0, coalesce(track_age, 1) / 5) * 0.22e0
   + CASE WHEN direct THEN least(1e0, ball_confidence / 0.45e0) ELSE least(0.55e0, ball_confidence / 0.2e0) END * 0.2e0), 4) AS subject_confidence FROM s""")
def _(v):
    return T.subject_confidence(v.frames.selectExpr(*SCF)).select("match_id", "scene_id", "frame", "subject_confidence")


ICR = ["match_id", "scene_id", "frame", "phase", "ball_x", "ball_y", "px - 0.02e0 AS px1", "px + 0.02e0 AS px2", "ptop", "pbottom", "camera_x"]
MRG = "CASE WHEN phase IN ('setup', 'contact') THEN least(0.035e0, 0.5e0 * 0.11e0) ELSE 0 END"
INS = lambda x, y, m: f"coalesce(abs({x} - camera_x) <= 0.25e0 - {m} AND abs({y} - 0.5e0) <= 0.5e0 - {m}, false)"


@query("in_crop", f"WITH c AS (SELECT {', '.join(ICR)} FROM frames_v) SELECT {KEYS}, frame, {INS('ball_x', 'ball_y', '0')} AS ball_in, {INS('px1', 'ptop', MRG)} AND {INS('px2', 'pbottom', MRG)} AS player_in, {INS('ball_x', 'ball_y', MRG)} AND {INS('px1', 'ptop', MRG)} AND {INS('px2', 'pbottom', MRG)} AS joint_in FROM c")
def _(v):
    return T.in_crop(v.frames.selectExpr(*ICR), 0.5).select("match_id", "scene_id", "frame", "ball_in", "player_in", "joint_in")


@query("payoff_target", """WITH r AS (SELECT *, start_ms + (end_ms - start_ms) * (ordinal % 9) // 8 AS at_ms FROM moments_v) SELECT moment_id, at_ms, proof_verified AND proof_event = event_type AND box_x1 < box_x2 AND box_x2 <= 1 AND box_y2 <= 1 AND (event_type <> 'goal' OR goal_focus_x IS NULL OR abs((box_x1 + box_x2) / 2 - goal_focus_x) <= greatest(0.18e0, (box_x2 - box_x1) * 0.75e0))
   AND proof_end_ms - proof_start_ms >= 500 AND at_ms BETWEEN proof_start_ms AND CASE WHEN event_type IN ('goal', 'disallowed_goal') THEN greatest(proof_end_ms, end_ms) ELSE proof_end_ms END AS on_target FROM r""")
def _(v):
    rows = v.moments.selectExpr("match_id", "moment_id", "start_ms + (end_ms - start_ms) * (ordinal % 9) div 8 AS at_ms")
    return T.payoff_target(rows, v.moments).select("moment_id", "at_ms", "on_target")


HM = ["match_id", "scene_id", "100e0 + (match_id % 12) AS h00", "2e0 AS h01", "-4e0 AS h02", "1e0 AS h10", "66e0 AS h11", "-3e0 + (scene_id % 3) AS h12", "0.05e0 AS h20", "0.02e0 AS h21", "1e0 AS h22"]


@query("project_pitch", f"""WITH h AS (SELECT {', '.join(HM)} FROM (SELECT DISTINCT {KEYS} FROM frames_v)), p AS (SELECT v.match_id, v.scene_id, v.frame, idx, (h00 * cx + h01 * y2 + h02) / (h20 * cx + h21 * y2 + h22) AS x, (h10 * cx + h11 * y2 + h12) / (h20 * cx + h21 * y2 + h22) AS y FROM players_v v JOIN h USING (match_id, scene_id)),
  o AS (SELECT *, x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 AS o FROM p) SELECT {KEYS}, frame, idx, round(x, 3) AS pitch_x, round(y, 3) AS pitch_y FROM o WHERE o AND (match_id, scene_id, frame) IN (SELECT (match_id, scene_id, frame) FROM o GROUP BY match_id, scene_id, frame HAVING avg(CASE WHEN o THEN 1e0 ELSE 0e0 END) >= 0.8e0)""")
def _(v):
    pts = v.players.selectExpr("match_id", "scene_id", "frame", "idx", "cx AS fx", "y2 AS fy")
    return T.project_pitch(pts, v.frames.select("match_id", "scene_id").distinct().selectExpr(*HM))


PB = ["match_id", "scene_id", "frame", "idx", "cx", "cy", "cx - 0.002e0 - (ordinal % 30) / 2048e0 AS x1", "cx + 0.002e0 AS x2", "cy - 0.004e0 AS y1", "cy + 0.004e0 + (ordinal % 17) / 512e0 AS y2"]


@query("plausible_balls", f"""WITH b AS (SELECT {', '.join(PB)} FROM balls_v), n AS (SELECT *, (y2 - y1) / (16e0 / 9) / 0.316e0 * 1080 AS h FROM (SELECT * REPLACE (y2 + (ordinal % 20) / 64e0 AS y2) FROM players_v) WHERE pitch_support >= 0.08e0), s AS (SELECT {KEYS}, frame, list_sort(list(h)) AS hs FROM n WHERE role <> 'referee' GROUP BY ALL),
  nb AS (SELECT b.match_id, b.scene_id, b.frame, b.idx, max(h) AS nh FROM b JOIN n USING (match_id, scene_id, frame) WHERE sqrt(pow(b.cx - n.cx, 2) + pow((b.cy - n.y2) / (16e0 / 9), 2)) <= 0.12e0 GROUP BY ALL),
  d AS (SELECT b.*, greatest(x2 - x1, (y2 - y1) / (16e0 / 9)) / 0.316e0 * 1080 AS dia, greatest(coalesce(hs[least(len(hs) - 1, CAST(floor(len(hs) * 0.75e0) AS BIGINT)) + 1], 0), coalesce(nh, 0)) AS body FROM b LEFT JOIN s USING (match_id, scene_id, frame) LEFT JOIN nb USING (match_id, scene_id, frame, idx))
  SELECT {KEYS}, frame, idx, round(dia, 4) AS diameter FROM d WHERE dia BETWEEN 4 AND greatest(70e0, least(240e0, body * 0.25e0))""")
def _(v):
    return T.plausible_balls(v.balls.selectExpr(*PB), v.players.withColumn("y2", F.expr("y2 + (ordinal % 20) / 64e0")), 0.316)


ATH = ["match_id", "scene_id", "frame", "t_ms * 3 AS t_ms", "9600 AS length_ms", "3000 + 100 * (match_id % 9) AS contact_ms", "5000 AS payoff_ms"]


@query("adaptive_thin", f"""WITH f AS (SELECT {', '.join(ATH)} FROM frames_v), r AS (SELECT *, CASE WHEN t_ms <= 1000 OR t_ms BETWEEN greatest(0, contact_ms - 1750) AND least(length_ms, payoff_ms + 1250) THEN 10 ELSE 2 END AS rate FROM f), k AS (SELECT *, CAST(floor(t_ms * rate / 1000) AS BIGINT) AS tick FROM r),
  l AS (SELECT *, lag(rate) OVER w AS pr, lag(tick) OVER w AS pt FROM k WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms)) SELECT {KEYS}, frame FROM l WHERE pr IS NULL OR pr <> rate OR pt <> tick""")
def _(v):
    return T.adaptive_thin(v.frames.selectExpr(*ATH), 10, 2)


@query("kit_distance", """WITH k AS (SELECT vec_id, label, [abs(x) FOR x IN embedding] AS e FROM embeddings), n AS (SELECT vec_id, label, [x / list_sum(e) FOR x IN e] AS h FROM k), r AS (SELECT label, min(vec_id) AS rid FROM n GROUP BY label)
  SELECT a.vec_id, round(CASE WHEN a.vec_id % 50 = 7 THEN 1e0 ELSE least(1e0, sqrt(greatest(0e0, 1 - list_sum([sqrt(a.h[i] * b.h[i]) FOR i IN range(1, 65)])))) END, 4) AS distance FROM n a JOIN r USING (label) JOIN n b ON b.vec_id = r.rid""")
def _(v):
    raw = v.parquet("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    unit = raw.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).select("vec_id", "label", F.expr("transform(e, x -> x / s)").alias("h"))
    ref = unit.groupBy("label").agg(F.min_by("h", "vec_id").alias("b"))
    pairs = unit.join(ref, "label").withColumn("a", F.when(F.expr("vec_id % 50 <> 7"), F.col("h")))
    return T.kit_distance(pairs).select("vec_id", "distance")


@query("simplify_path")
def _(v):
    return T.simplify_path(v.frames, 0.1)


@query("associate_people")
def _(v):
    return T.associate_people(v.frames, v.players.withColumn("kit", F.expr("(idx % 2) / 2e0")))


@query("associate_ball")
def _(v):
    return T.associate_ball(v.frames, v.balls.drop("t_ms").withColumn("near", F.expr("(ordinal % 40) / 128e0")))


PA = ["match_id", "scene_id", "frame", "t_ms * 3 AS t_ms", "k % 97 = 0 AS cut", "k % 6 <> 0 AS possession", "k % 11 <> 0 AS direct", "k % 7 <> 2 AS joint_fit", "0.7e0 + (k % 5) / 32e0 AS subject_confidence", "CASE WHEN k % 29 <> 3 THEN CAST(floor((frame + match_id % 3) / 5) AS BIGINT) % 3 END AS track_id",
      "CASE WHEN k % 13 = 5 THEN 'contact' ELSE phase END AS phase", "CASE WHEN k % 11 <> 0 THEN k / 128e0 END AS ball_x", "0.5e0 + (k % 7) / 64e0 AS ball_y"]
PP = ["match_id", "scene_id", "frame", "idx", "(idx + k) % 4 AS track_id", "cx", "y2"]
PQ = ["match_id", "scene_id", "CAST(300 * (match_id % 30) AS BIGINT) AS want_ms"]
NEXT = "r.match_id = a.match_id AND r.scene_id = a.scene_id AND r.t_ms > a.t_ms AND r.t_ms <= a.t_ms + 5000"


@query("pass_anchor", f"""WITH f AS (SELECT {', '.join(PA)} FROM frames_v), p AS (SELECT {', '.join(PP)} FROM players_v), q AS (SELECT {', '.join(PQ)} FROM (SELECT DISTINCT {KEYS} FROM frames_v)),
  h AS (SELECT *, possession AND track_id IS NOT NULL AND subject_confidence >= 0.7e0 AS owns FROM f), l AS (SELECT *, owns AND direct AND lead(owns AND direct, 1) OVER w AND lead(owns AND direct, 2) OVER w AND lead(track_id, 1) OVER w = track_id AND lead(track_id, 2) OVER w = track_id AS turns, lead(t_ms, 2) OVER w AS three FROM h WINDOW w AS (PARTITION BY {KEYS} ORDER BY t_ms)),
  a AS (SELECT *, (SELECT arg_min(r.track_id, r.t_ms) FROM l r WHERE {NEXT} AND r.phase = 'contact' AND r.owns) AS owner, (SELECT count(*) FROM l r WHERE r.match_id = a.match_id AND r.scene_id = a.scene_id AND r.t_ms BETWEEN a.t_ms - 500 AND a.t_ms AND r.track_id = a.track_id AND r.possession) AS steady
    FROM l a WHERE direct AND joint_fit AND possession AND subject_confidence >= 0.78e0 AND track_id IS NOT NULL AND ball_x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l r WHERE {NEXT} AND r.cut)),
  b AS (SELECT a.*, p.track_id AS to_id, idx, cx, y2 FROM a JOIN p ON p.match_id = a.match_id AND p.scene_id = a.scene_id AND p.frame = a.frame AND p.track_id <> a.track_id QUALIFY row_number() OVER (PARTITION BY a.match_id, a.scene_id, a.frame, p.track_id ORDER BY idx) = 1),
  c AS (SELECT *, 0 AS way FROM b WHERE to_id = owner AND steady >= 2 AND sqrt(pow(ball_x - cx, 2) + pow(ball_y - y2, 2)) >= 0.045e0 UNION ALL SELECT *, 1 FROM b a WHERE EXISTS (SELECT 1 FROM l r WHERE {NEXT} AND r.turns AND r.three <= a.t_ms + 5000 AND r.track_id = a.to_id)),
  d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {KEYS}, frame ORDER BY way, idx) = 1), n AS (SELECT f.match_id, f.scene_id, any_value(want_ms) AS want_ms, arg_min(t_ms, struct_pack(g := abs(t_ms - want_ms), t := t_ms)) AS near_ms, max(t_ms) FILTER (phase = 'contact') AS touch_ms FROM f JOIN q ON q.match_id = f.match_id AND q.scene_id = f.scene_id GROUP BY ALL),
  e AS (SELECT d.*, want_ms, near_ms FROM d JOIN n ON n.match_id = d.match_id AND n.scene_id = d.scene_id QUALIFY row_number() OVER (PARTITION BY d.match_id, d.scene_id ORDER BY t_ms = near_ms DESC, coalesce(touch_ms > t_ms, false) DESC, t_ms DESC) = 1)
  SELECT {KEYS}, t_ms AS anchor_ms, to_id, ball_x AS from_x, ball_y AS from_y, cx AS to_x, y2 AS to_y FROM e WHERE t_ms = near_ms OR abs(t_ms - want_ms) <= 7000""")
def _(v):
    return T.pass_anchor(v.frames.selectExpr(*PA), v.players.selectExpr(*PP), v.frames.select("match_id", "scene_id").distinct().selectExpr(*PQ))
