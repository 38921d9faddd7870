"""Streaming operators replayed over derived tables, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.plans.catalog.ledger import LEDGER_SQL, READABLE
from matchspark.plans.catalog.tracks import ENDS_SQL
from matchspark.plans.registry import query
from matchspark.streaming import streams as S

#: Event times start on a day of their own: a row at the very first instant is already behind the first watermark.
DAY = 1_704_067_200_000
AT = f"CAST(timestamp_millis({DAY} + t_ms) AS TIMESTAMP) AS at"


@query("stream_phase_wall_time", """WITH n AS (SELECT *, lead(us) OVER w AS nu, lead(restarted) OVER w AS nr, lead(event_id) OVER w AS ne FROM job_events_v WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id))
  SELECT job_id, ne AS event_id, coalesce(phase, stage) AS phase, (nu - us) // 1000 AS wall_ms FROM n WHERE stage <> 'completed' AND nu IS NOT NULL AND NOT nr""")
def _(v):
    return S.replay(v.spark, v.job_events, lambda s: S.phase_wall_time(s, ttl_ms=60 * 86_400_000), order="us")


@query("stream_score_ledger", LEDGER_SQL + """ SELECT match_id, x.n AS no, x.side AS side, x.status AS status, x.b AS before_ms, x.f AS after_ms FROM (SELECT match_id, unnest(anchors) AS x FROM final)""")
def _(v):
    samples = v.score_samples.withColumn("readable", F.expr(READABLE)).where("t_ms <= 5110000").selectExpr("match_id", "t_ms", "home", "away", "clock", "readable", AT)
    rows = S.replay(v.spark, samples, S.score_ledger, order="t_ms")
    undone = rows.where("kind = 'reversal'").select("match_id", "no", F.lit("reversed").alias("status"))
    return rows.where("kind = 'anchor'").drop("kind").join(undone, ["match_id", "no"], "left").withColumn("status", F.coalesce("status", F.lit("provisional")))


@query("stream_fill_gaps", f"WITH {ENDS_SQL} SELECT match_id, scene_id, frame, round(p.x * (1 - a) + q.x * a + 1e-9, 5) AS guide_x, round(p.y * (1 - a) + q.y * a + 1e-9, 5) AS guide_y FROM li WHERE gap <= 450")
def _(v):
    frames = v.frames.selectExpr("match_id", "scene_id", "frame", "t_ms", "cut", "ball_x", "ball_y", AT)
    out = S.replay(v.spark, frames, S.fill_gaps, order="t_ms")
    return out.select("match_id", "scene_id", "frame", F.round(F.col("guide_x") + 1e-9, 5).alias("guide_x"), F.round(F.col("guide_y") + 1e-9, 5).alias("guide_y"))


@query("ingest_sections", """SELECT s.match_id, CAST(s.section AS BIGINT) AS section, count(m.moment_id) AS moments FROM (SELECT match_id, unnest(range(30)) AS section FROM sources_v) s
  LEFT JOIN moments_v m ON m.match_id = s.match_id AND m.start_ms // 180000 = s.section GROUP BY ALL""")
def _(v):
    """Every section of every match, those without a moment too, each delivered twice and taken once."""
    tiles = v.sources.selectExpr("match_id", "explode(sequence(0L, 29L)) AS section")
    found = v.moments.groupBy("match_id", F.expr("start_ms div 180000").alias("section")).agg(F.count("*").alias("moments"))
    rows = tiles.join(found, ["match_id", "section"], "left").selectExpr("match_id", "section", "coalesce(moments, 0L) AS moments", f"CAST(timestamp_millis({DAY} + section * 180000) AS TIMESTAMP) AS at", "explode(array(0, 1)) AS attempt")
    out = S.replay(v.spark, rows, lambda s: S.ingest_sections(s.drop("attempt"), "3 hours"))
    return out.select("match_id", "section", "moments")
