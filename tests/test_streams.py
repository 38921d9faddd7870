"""Stream forms over several micro-batches against the batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from matchspark.operators import ledger as L
from matchspark.operators import tracks as T
from matchspark.session import ensure_checkpoint_dir
from matchspark.streaming import streams as S

T0 = datetime(2024, 1, 1)


def feed(spark, batches, stream, schema):
    """Write one file per batch and trigger after each, on one checkpoint."""
    import uuid

    base = f"{ensure_checkpoint_dir(spark)}/feed/{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = (stream(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_gap_closed_by_a_later_batch(spark):
    schema = "match_id long, scene_id long, frame long, t_ms long, cut boolean, ball_x double, ball_y double, at timestamp"
    rows = [(1, 1, i, 100 * i, i == 6, x, x, T0 + timedelta(milliseconds=100 * i)) for i, x in enumerate([0.2, None, None, 0.5, None, 0.6, None, 0.7, None, None, None, None, None, 0.9])]
    got = feed(spark, [rows[:2], rows[2:9], rows[9:]], S.fill_gaps, schema)
    want = T.fill_gaps(spark.createDataFrame(rows, schema))
    assert sorted((r.frame, round(r.guide_x, 4)) for r in got.collect()) == sorted((r.frame, round(r.guide_x, 4)) for r in want.collect())


def test_ledger_across_restarts(spark):
    schema = "match_id long, sample_id long, t_ms long, home long, away long, clock string, readable boolean, at timestamp"
    scores = [(0, 0), (1, 0), (1, 1), (1, 0), (3, 0), (3, 1), (2, 1)]
    rows = [(1, i + 1, 10_000 * i, h, a, f"0{i}:00", True, T0 + timedelta(seconds=10 * i)) for i, (h, a) in enumerate(scores)]
    got = feed(spark, [rows[:3], rows[3:5], rows[5:]], S.score_ledger, schema).collect()
    batch = L.score_ledger(spark.createDataFrame(rows, schema), 5_400_000)
    anchors = {r.after_ms for r in L.ledger_anchors(batch).collect()}
    undone = {r.anchor_id for r in L.ledger_anchors(batch).where("status = 'reversed'").collect()}
    assert {r.after_ms for r in got if r.kind == "anchor"} == anchors
    assert {f"score-incident-{r.no}" for r in got if r.kind == "reversal"} == undone
    assert sum(r.kind not in ("anchor", "reversal") for r in got) == L.ledger_unresolved(batch).count()


def test_minute_buckets_close_behind_the_watermark(spark):
    schema = "job_id string, model string, status string, prompt_tokens long, at timestamp"
    t0 = T0
    rows = [("j", "m", "success" if i % 3 else "capacity", i, t0 + timedelta(seconds=20 * i)) for i in range(9)]
    got = feed(spark, [rows, [("j", "m", "success", 1, t0 + timedelta(hours=2))], [("j", "m", "success", 1, t0 + timedelta(hours=3))]], S.minute_buckets, schema)
    first = got.orderBy("window.start").first()
    assert (first.requests, first.limited, first.prompt_tokens) == (3, 1, 3)


def test_section_is_consumed_once(spark):
    schema = "match_id long, section long, at timestamp"
    t = T0
    got = feed(spark, [[(1, 1, t), (1, 2, t)], [(1, 1, t), (1, 3, t)]], S.ingest_sections, schema)
    assert sorted(r.section for r in got.collect()) == [1, 2, 3]
    assert got.agg(F.count(F.lit(1))).first()[0] == 3


EVENT = "job_id string, event_id long, us long, stage string, phase string, restarted boolean"


def event(job, n, hours):
    return (job, n, int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6 + hours * 3_600_000_000), "tracking", None, False)


def test_state_ends_behind_the_watermark_and_late_rows_are_dropped(spark):
    quiet, busy = "a", "b"
    batches = [
        [event(quiet, 1, 0), event(busy, 2, 0)], [event(busy, 3, 1), event(quiet, 4, 0.5)],
        [event(busy, 5, 30)],  # the watermark passes the quiet job's last row by more than its time to live
        [event(quiet, 6, 31), event(busy, 7, 31), event(busy, 8, 2)],  # the last one is late
        [event(quiet, 9, 32)],
    ]
    got = feed(spark, batches, lambda s: S.phase_wall_time(s, "10 minutes", 12 * 3_600_000), EVENT)
    assert sorted((r.event_id, r.wall_ms // 60_000) for r in got.collect()) == [(3, 60), (4, 30), (5, 1740), (7, 60), (9, 60)]  # row 6 finds no state


def test_newest_minutes(spark):
    rows = [("j", "m", (T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 1)), i) for i in range(70)] + [("j", "n", (T0, T0), 0)]
    df = spark.createDataFrame(rows, "job_id string, model string, window struct<start: timestamp, end: timestamp>, requests long")
    got = S.newest_minutes(df).collect()
    assert sorted(r.requests for r in got if r.model == "m") == list(range(10, 70)) and len(got) == 61


def test_rows_of_a_trigger_are_put_in_event_order_as_plain_tuples():
    import pandas as pd

    from matchspark.streaming import streams as S

    parts = [pd.DataFrame({"us": [3, 1], "event_id": [0, 2], "stage": ["c", "b"], "phase": [None, "p"], "restarted": False}), pd.DataFrame({"us": [1], "event_id": [1], "stage": ["a"], "phase": ["q"], "restarted": True})]
    got = S._ordered(parts, S.Step, 2)
    assert [(r.us, r.event_id, r.stage, r.phase, r.restarted) for r in got] == [(1, 1, "a", "q", True), (1, 2, "b", "p", False), (3, 0, "c", None, False)]
