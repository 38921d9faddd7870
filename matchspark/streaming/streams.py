"""Streaming forms of the telemetry, score and gap-filling operators.

Keyed state is small and of fixed shape per key. Within one trigger a key's rows
are put in event order first; what one trigger takes up bounds how many there are.
Rows carry their event time in ``at``. Rows behind the watermark are dropped; a
key whose last row lies ``ttl_ms`` behind it loses its state, and starts anew if
rows come again.
"""

from __future__ import annotations

import json
import uuid
from collections import namedtuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchspark.functions.scalar import match_clock_seconds
from matchspark.session import ensure_checkpoint_dir


def minute_buckets(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One-minute request buckets per job and model by provider start time (``at``)."""
    rows = requests.withWatermark("at", late).where("model IS NOT NULL")
    return rows.groupBy("job_id", "model", F.window("at", "1 minute")).agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status") == "capacity", 1)).alias("limited"),
        F.sum(F.greatest(F.lit(0), F.coalesce("prompt_tokens", F.lit(0)))).alias("prompt_tokens"))


def ingest_sections(sections: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each section result once, empty ones included; the checkpoint keeps a restart from repeating it."""
    return sections.withWatermark("at", late).dropDuplicatesWithinWatermark(["match_id", "section"])


def _stateful(rows: DataFrame, keys: list[str], step, schema: str, state: str, late: str, ttl_ms: int) -> DataFrame:
    """Run ``step(key, batches, state)`` per key; the state ends by an event-time timer ``ttl_ms`` after the key's last row."""

    def timed(key, batches, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        seen = list(batches)
        yield from step(key, seen, held)
        newest = max(int(b["at"].to_numpy().max().astype("datetime64[ms]").astype("int64")) for b in seen if len(b))
        held.setTimeoutTimestamp(max(newest, held.getCurrentWatermarkMs()) + ttl_ms)

    return rows.withWatermark("at", late).groupBy(*keys).applyInPandasWithState(timed, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def newest_minutes(buckets: DataFrame, keep: int = 60) -> DataFrame:
    """The newest ``keep`` minutes of each job and model among closed buckets."""
    order = Window.partitionBy("job_id", "model").orderBy(F.col("window.start").desc())
    return buckets.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def _ordered(batches, row, by: int) -> list:
    """The rows as named tuples ``row``, in the order of its first ``by`` fields. A key has few rows, so plain lists are fastest."""
    rows = [r for b in batches for r in zip(*(b[c].tolist() for c in row._fields))]
    rows.sort(key=lambda r: r[:by])
    return list(map(row._make, rows))


Step = namedtuple("Step", "us event_id stage phase restarted")
Reading = namedtuple("Reading", "t_ms home away clock_s")
Frame = namedtuple("Frame", "t_ms frame cut ball_x ball_y")


def _phase_spans(key, batches, state: GroupState):
    last = state.get if state.exists else None
    out = []
    for r in _ordered(batches, Step, 2):
        if last is not None and last[2] != "completed" and not r.restarted:
            out.append((key[0], int(r.event_id), last[1], (int(r.us) - last[0]) // 1000))
        last = (int(r.us), r.phase if r.phase is not None else r.stage, r.stage)
    state.update(last)
    if out:
        yield pd.DataFrame(out, columns=["job_id", "event_id", "phase", "wall_ms"])


def phase_wall_time(events: DataFrame, late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """Wall time closed by each job event, charged to the phase before it. The phase open when a job goes quiet has none."""
    rows = events.withColumn("at", F.timestamp_micros("us"))
    return _stateful(rows, ["job_id"], _phase_spans, "job_id string, event_id long, phase string, wall_ms long", "us long, phase string, stage string", late, ttl_ms)


def _ledger_step(key, batches, state: GroupState):
    prev, anchors, opened = (None, [], 0)
    if state.exists:
        saved = json.loads(state.get[0])
        prev, anchors, opened = saved["prev"], saved["anchors"], saved["opened"]
    out = []
    for r in _ordered(batches, Reading, 1):
        clock = None if pd.isna(r.clock_s) else int(r.clock_s)
        now = [int(r.t_ms), int(r.home), int(r.away), clock]
        if prev is not None:
            if now[0] <= prev[0] or (clock is not None and prev[3] is not None and clock < prev[3] - 2):
                continue
            dh, da = now[1] - prev[1], now[2] - prev[2]
            side = "home" if dh else "away"
            if abs(dh) + abs(da) == 1 and dh + da == 1:
                opened += 1
                anchors.append([opened, side, now[1], now[2]])
                out.append((key[0], "anchor", opened, side, prev[0], now[0]))
            elif abs(dh) + abs(da) == 1:
                hit = next((a for a in reversed(anchors) if a[1] == side and a[2:] == prev[1:3]), None)
                if hit is None:
                    out.append((key[0], "unmatched_score_reversal", 0, side, prev[0], now[0]))
                else:
                    anchors.remove(hit)
                    out.append((key[0], "reversal", hit[0], side, prev[0], now[0]))
            elif dh or da:
                out.append((key[0], "multiple_or_inconsistent_score_change", 0, side, prev[0], now[0]))
        prev = now
    state.update((json.dumps({"prev": prev, "anchors": anchors, "opened": opened}),))
    if out:
        yield pd.DataFrame(out, columns=["match_id", "kind", "no", "side", "before_ms", "after_ms"])


def score_ledger(samples: DataFrame, late: str = "10 minutes", ttl_ms: int = 21_600_000) -> DataFrame:
    """Score changes as they are read: anchors, reversals and unexplained changes.

    Scores end at 20, so the open anchors kept per match are at most forty. A match quiet for ``ttl_ms`` is over.
    """
    ok = samples.where("readable AND home BETWEEN 0 AND 20 AND away BETWEEN 0 AND 20").withColumn("clock_s", match_clock_seconds(F.col("clock")))
    rows = ok.select("match_id", "t_ms", "home", "away", "clock_s", "at")
    return _stateful(rows, ["match_id"], _ledger_step, "match_id long, kind string, no long, side string, before_ms long, after_ms long", "body string", late, ttl_ms)


def _gap_step(max_gap_ms: int):
    def step(key, batches, state: GroupState):
        last, waiting = (None, [])
        if state.exists:
            last, waiting = json.loads(state.get[0])
        out = []
        for r in _ordered(batches, Frame, 1):
            if r.cut:
                last, waiting = None, []
            if pd.isna(r.ball_x):
                # rows past the allowed gap can never be bridged, so waiting rows stay few
                if last is not None and r.t_ms - last[0] < max_gap_ms:
                    waiting.append((int(r.frame), int(r.t_ms)))
                continue
            if last is not None and r.t_ms - last[0] <= max_gap_ms:
                for frame, t in waiting:
                    a = (t - last[0]) / (r.t_ms - last[0])
                    out.append((*key, frame, last[1] * (1 - a) + r.ball_x * a, last[2] * (1 - a) + r.ball_y * a))
            last, waiting = (int(r.t_ms), float(r.ball_x), float(r.ball_y)), []
        state.update((json.dumps((last, waiting)),))
        if out:
            yield pd.DataFrame(out, columns=["match_id", "scene_id", "frame", "guide_x", "guide_y"])

    return step


def fill_gaps(frames: DataFrame, max_gap_ms: int = 450, late: str = "1 minute", ttl_ms: int = 600_000) -> DataFrame:
    """Interpolated rows, emitted when the right endpoint arrives within the gap.

    Rows still waiting when a scene has been quiet for ``ttl_ms`` have no right endpoint and stay empty.
    """
    rows = frames.select("match_id", "scene_id", "frame", "t_ms", "cut", "ball_x", "ball_y", "at")
    return _stateful(rows, ["match_id", "scene_id"], _gap_step(max_gap_ms), "match_id long, scene_id long, frame long, guide_x double, guide_y double", "body string", late, ttl_ms)


def replay(spark: SparkSession, table: DataFrame, stream, order: str | None = None, triggers: int = 3) -> DataFrame:
    """Run a streaming operator over a stored table in several triggers and return what it wrote.

    The table arrives in ``triggers`` parts, by ranges of ``order`` (cut at approximate quantiles) or by hash. Each part
    is appended to the stream's folder under the shared checkpoint folder, as many files as it has partitions, and one
    ``availableNow`` run on the same checkpoint takes it up; state carries over. The sink is read back.
    """
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    if order:
        cuts = sorted(set(table.approxQuantile(order, [i / triggers for i in range(1, triggers)], 0.05)))
        slot = sum((F.when(F.col(order) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))  # a null comes first
        parts = [slot == i for i in range(len(cuts) + 1)]
    else:
        parts = [F.pmod(F.xxhash64(*table.columns), F.lit(triggers)) == i for i in range(triggers)]
    for part in parts:
        table.where(part).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(table.schema).parquet(f"{base}/in")
        query = (
            stream(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
