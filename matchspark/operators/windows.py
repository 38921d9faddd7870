"""Source windows, gaps, camera shots and clocks on the media time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.scalar import SCORING, SHOTS, candidate_state, deferred, is_true, kept, length_ms, reaction, replay
from matchspark.operators.timeline import BLOCK_MS, block_of, covered_by, covered_length, interval_join, scan

# Events that count as playable action, and those aligned by phase.
ACTION_EVENTS = [
    "goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance", "tackle", "free_kick",
    "normal_play", "assist", "dribble",
]
PHASE_EVENTS = ["disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance", "free_kick"]


def section_windows(sources: DataFrame, chunk_ms: int = 180_000, overlap_ms: int = 4_000) -> DataFrame:
    """Overlapping tiles over each source; a tail the previous tile covers is dropped."""
    step = chunk_ms - overlap_ms
    d = F.col("duration_ms")
    last = F.greatest(F.lit(-1).cast("long"), F.ceil((d - 50) / F.lit(step)) - 1)
    tiles = sources.where("duration_ms > 50").select(
        "match_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")
    )
    left = d - F.col("i") * step
    return tiles.where((F.col("i") == 0) | (left > overlap_ms + 50)).select(
        "match_id", "duration_ms", (F.col("i") + 1).alias("section"), (F.col("i") * step).alias("start_ms"),
        F.least(F.lit(chunk_ms), left).alias("length_ms"),
    )


def section_plan(sources: DataFrame, minimum_ms: int = 60_000, chunk_ms: int = 180_000, overlap_ms: int = 6_000) -> DataFrame:
    """Tiles with the end of their own core and a proportional observation budget."""
    step = chunk_ms - overlap_ms
    tiles = section_windows(sources, chunk_ms, overlap_ms)
    nxt = F.col("start_ms") + step
    has_next = (nxt < F.col("duration_ms") - 50) & (F.col("duration_ms") - nxt > overlap_ms + 50)
    core = F.when(has_next, nxt).otherwise(F.col("duration_ms"))
    planned = F.least(F.col("duration_ms"), F.lit(minimum_ms + max(20_000, minimum_ms // 2)))
    ask = F.floor(planned * (core - F.col("start_ms")) / F.col("duration_ms") + 0.5)
    return tiles.select("match_id", "section", "start_ms", "length_ms", core.alias("core_end_ms"), ask.alias("requested_ms"))


def shot_inventory(shots: DataFrame, sources: DataFrame) -> DataFrame:
    """Clip shots to the source and drop slivers; ids follow the input index."""
    clipped = shots.join(sources.select("match_id", "duration_ms"), "match_id").select(
        "match_id", F.format_string("shot-%04d", F.col("index")).alias("shot_id"),
        F.least(F.greatest(F.lit(0), "shot_start_ms"), "duration_ms").alias("start_ms"),
        F.least(F.greatest(F.lit(0), "shot_end_ms"), "duration_ms").alias("end_ms"),
    )
    return clipped.where("end_ms - start_ms >= 250")


def clip_shots(shots: DataFrame, sections: DataFrame) -> DataFrame:
    """Shots inside each section on the section's own clock."""
    span = sections.select(
        "match_id", "section", F.col("start_ms").alias("sec_ms"), (F.col("start_ms") + F.col("length_ms")).alias("sec_end_ms")
    )
    pairs = interval_join(shots, span, ["match_id"], ("shot_start_ms", "shot_end_ms"), ("sec_ms", "sec_end_ms"))
    s, e = F.greatest("shot_start_ms", "sec_ms"), F.least("shot_end_ms", "sec_end_ms")
    return pairs.where(e - s >= 250).select(
        "match_id", "section", "shot_id", (s - F.col("sec_ms")).alias("local_start_ms"), (e - F.col("sec_ms")).alias("local_end_ms"),
        s.alias("source_start_ms"), e.alias("source_end_ms"),
    )


def passage_fits(passages: DataFrame, ledger: DataFrame, tol_ms: int = 80) -> DataFrame:
    """Whether a passage lies inside the consecutive shots it declares.

    ``ledger`` carries ``shot_no``, the shot's position. Declared lists are short,
    so the check per passage stays inside one small group.
    """
    named = passages.select("match_id", "moment_id", "start_ms", "end_ms", F.posexplode("shot_ids").alias("pos", "shot_id"))
    hit = named.join(ledger.select("match_id", "shot_id", "shot_no", "shot_start_ms", "shot_end_ms"), ["match_id", "shot_id"], "left")
    run = hit.groupBy("match_id", "moment_id", "start_ms", "end_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count("shot_no").alias("found"), F.countDistinct("shot_id").alias("distinct_ids"),
        F.min(F.col("shot_no") - F.col("pos")).alias("lo"), F.max(F.col("shot_no") - F.col("pos")).alias("hi"),
        F.min_by("shot_start_ms", "pos").alias("first_ms"), F.max_by("shot_end_ms", "pos").alias("last_ms"),
    )
    ok = (
        (F.col("n") == F.col("found")) & (F.col("n") == F.col("distinct_ids")) & (F.col("lo") == F.col("hi"))
        & (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= F.col("first_ms") - tol_ms)
        & (F.col("end_ms") <= F.col("last_ms") + tol_ms)
    )
    return run.select("match_id", "moment_id", F.coalesce(ok, F.lit(False)).alias("fits"))


def covered_seconds(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Union length of the valid intervals of each key."""
    valid = moments.where("end_ms > start_ms").select(*keys, "start_ms", "end_ms", "ordinal")
    return covered_length(valid, keys, "start_ms", "end_ms", ["ordinal"]).groupBy(*keys).agg(F.sum("new_ms").alias("covered_ms"))


def coverage_gaps(moments: DataFrame, sources: DataFrame, min_gap_ms: int = 8_000, max_window_ms: int = 42_000) -> DataFrame:
    """Search windows over the footage no verified moment covers.

    A gap becomes equal chunks of at most ``max_window_ms`` with 1.5 s pads.
    """
    span = (
        moments.where(candidate_state() == "verified").join(sources.select("match_id", "duration_ms"), "match_id")
        .select("match_id", "ordinal", F.greatest(F.lit(0), "start_ms").alias("s"), F.least("end_ms", "duration_ms").alias("e"))
        .where("e > s")
    )
    edge = span.groupBy("match_id").agg(
        F.min("s").alias("first_s"), F.max_by("e", F.struct("s", "ordinal")).alias("last_e"), F.max("e").alias("reach")
    )
    seen = scan(span, ["match_id"], ["s", "ordinal"], block_of(F.col("s"), BLOCK_MS), prior={"reach": ("max", F.col("e"))})
    inner = seen.select("match_id", F.coalesce("reach", F.lit(0)).alias("g0"), F.col("s").alias("g1"))
    src = sources.select("match_id", "duration_ms")
    tail = src.join(edge, "match_id", "left").select("match_id", F.coalesce("reach", F.lit(0)).alias("g0"), F.col("duration_ms").alias("g1"))
    gaps = inner.unionByName(tail).where(F.col("g1") - F.col("g0") >= min_gap_ms)
    n = F.ceil((F.col("g1") - F.col("g0")) / F.lit(max_window_ms))
    cut = (
        gaps.join(src, "match_id").join(edge.select("match_id", "first_s", "last_e"), "match_id", "left")
        .withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    )
    size = (F.col("g1") - F.col("g0")) / F.col("n")
    lo = F.col("g0") + F.col("i") * size - F.when(F.col("i") > 0, 1500).otherwise(0)
    hi = F.col("g0") + (F.col("i") + 1) * size + F.when(F.col("i") < F.col("n") - 1, 1500).otherwise(0)
    first = F.coalesce("first_s", "duration_ms")
    last = F.coalesce("last_e", F.lit(0))
    return cut.select(
        "match_id", F.floor(F.greatest(F.lit(0.0), lo)).alias("start_ms"), F.floor(F.least(F.col("duration_ms").cast("double"), hi)).alias("end_ms"),
        F.round(size, 3).alias("uncovered_ms"), ((F.col("g0") >= first) & (F.col("g1") <= last)).alias("interior"),
        (F.col("first_s").isNotNull() & (F.col("g0") < first)).alias("opening"),
    )


def rank_gaps(gaps: DataFrame, searched: DataFrame, sources: DataFrame, limit: int = 4, context_ms: int = 0) -> DataFrame:
    """The windows worth searching: not already searched, interior first, then longest."""
    seen = covered_by(gaps, searched, ["match_id"], ("start_ms", "end_ms"), ("s_start_ms", "s_end_ms"), ["start_ms", "end_ms"])
    fresh = seen.where(F.col("covered_ms") < (F.col("end_ms") - F.col("start_ms")) * 0.85)
    order = Window.partitionBy("match_id").orderBy(
        F.desc(F.col("interior") | F.col("opening")), F.desc("uncovered_ms"), "start_ms"
    )
    top = fresh.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    return top.join(sources.select("match_id", "duration_ms"), "match_id").select(
        "match_id", F.greatest(F.lit(0), F.col("start_ms") - context_ms).alias("start_ms"),
        F.least("duration_ms", F.col("end_ms") + context_ms).alias("end_ms"),
    )


def chop_windows(windows: DataFrame, sources: DataFrame, max_ms: int = 42_000, overlap_ms: int = 10_000) -> DataFrame:
    """Bounded overlapping pieces of each window, without duplicates."""
    step = max_ms - overlap_ms
    clipped = windows.join(sources.select("match_id", "duration_ms"), "match_id").select(
        "match_id", F.least(F.greatest(F.lit(0), "start_ms"), "duration_ms").alias("s"),
        F.least(F.greatest(F.lit(0), "end_ms"), "duration_ms").alias("e"),
    ).where("e - s >= 2000")
    more = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("e") - F.col("s") - max_ms) / F.lit(step)))
    return clipped.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), more))).select(
        "match_id", (F.col("s") + F.col("i") * step).alias("start_ms"),
        F.least(F.col("e"), F.col("s") + F.col("i") * step + max_ms).alias("end_ms"),
    ).distinct()


def goal_gap_windows(unresolved: DataFrame, moments: DataFrame, sources: DataFrame, searched: DataFrame, limit: int = 4) -> DataFrame:
    """Windows around unexplained score jumps; generic gaps only where none is left."""
    wide = unresolved.select("match_id", (F.col("start_ms") - 10_000).alias("start_ms"), (F.col("end_ms") + 10_000).alias("end_ms"))
    pieces = chop_windows(wide, sources)
    seen = covered_by(pieces, searched, ["match_id"], ("start_ms", "end_ms"), ("s_start_ms", "s_end_ms"), ["start_ms", "end_ms"])
    fresh = seen.where(F.col("covered_ms") < (F.col("end_ms") - F.col("start_ms")) * 0.85)
    order = Window.partitionBy("match_id").orderBy("start_ms", "end_ms")
    first = fresh.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("match_id", "start_ms", "end_ms")
    generic = rank_gaps(coverage_gaps(moments, sources, 4_000), searched, sources, limit, 2_000)
    rest = generic.join(first.select("match_id").distinct(), "match_id", "left_anti")
    return first.withColumn("origin", F.lit("score_jump")).unionByName(rest.withColumn("origin", F.lit("gap")))


def unobserved_shots(shots: DataFrame, moments: DataFrame, searched: DataFrame, sources: DataFrame, limit: int = 4) -> DataFrame:
    """Longest shots neither fully searched nor almost covered by one proven moment."""
    cut = shots.join(sources.select("match_id", "duration_ms"), "match_id").select(
        "match_id", "shot_id", F.greatest(F.lit(0), "shot_start_ms").alias("start_ms"), F.least("shot_end_ms", "duration_ms").alias("end_ms")
    ).where("end_ms - start_ms >= 2000")
    seen = covered_by(cut, searched, ["match_id"], ("start_ms", "end_ms"), ("s_start_ms", "s_end_ms"), ["shot_id"])
    todo = seen.where(F.col("covered_ms") < F.col("end_ms") - F.col("start_ms") - 100)
    proven = (
        moments.where(is_true("semantic_verified") & is_true("action_complete") & kept() & ~deferred())
        .groupBy("match_id", F.col("start_ms").alias("m_start")).agg(F.max("end_ms").alias("m_end"))
    )
    both = interval_join(todo, proven, ["match_id"], ("start_ms", "end_ms"), ("m_start", "m_end"))
    shared = F.least("end_ms", "m_end") - F.greatest("start_ms", "m_start")
    done = both.where(shared >= (F.col("end_ms") - F.col("start_ms")) * 0.95).select("match_id", "shot_id").distinct()
    order = Window.partitionBy("match_id").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms")
    left = todo.join(done, ["match_id", "shot_id"], "left_anti")
    return left.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("match_id", "shot_id", "start_ms", "end_ms")


def camera_segments(moments: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots overlapping a moment by more than 30 ms, clipped to it."""
    pairs = interval_join(
        moments.select("match_id", "moment_id", "start_ms", "end_ms"), shots.select("match_id", "shot_id", "shot_start_ms", "shot_end_ms"),
        ["match_id"], ("start_ms", "end_ms"), ("shot_start_ms", "shot_end_ms"),
    )
    hit = pairs.where((F.col("shot_end_ms") > F.col("start_ms") + 30) & (F.col("shot_start_ms") < F.col("end_ms") - 30))
    return hit.select(
        "match_id", "moment_id", "shot_id", F.greatest("start_ms", "shot_start_ms").alias("seg_start_ms"), F.least("end_ms", "shot_end_ms").alias("seg_end_ms")
    )


def split_views(moments: DataFrame, shots: DataFrame) -> DataFrame:
    """One candidate per whole camera view of a multi-shot incident; the parent stays."""
    apt = (is_true("score_observation") | is_true("additional_action")) & F.col("event_type").isin(*ACTION_EVENTS) & ~is_true("view_split")
    seg = camera_segments(moments.where(apt), shots)
    many = seg.groupBy("match_id", "moment_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    order = Window.partitionBy("match_id", "moment_id").orderBy("seg_start_ms", "shot_id")
    views = (
        seg.where("seg_end_ms - seg_start_ms >= 2500").join(many, ["match_id", "moment_id"], "left_semi")
        .select("match_id", F.col("moment_id").alias("parent_id"), "seg_start_ms", "seg_end_ms",
                F.concat_ws("-shot-", "moment_id", F.row_number().over(order).cast("string")).alias("moment_id"))
        .join(moments.select("match_id", "moment_id"), ["match_id", "moment_id"], "left_anti")
        .select("match_id", "moment_id", "parent_id", F.col("seg_start_ms").alias("start_ms"), F.col("seg_end_ms").alias("end_ms"))
    )
    own = moments.select("match_id", "moment_id", F.lit(None).cast("string").alias("parent_id"), "start_ms", "end_ms")
    return views.unionByName(own)


def score_shot_proposals(anchors: DataFrame, shots: DataFrame, moments: DataFrame) -> DataFrame:
    """Camera shots near a score change as new candidates, unless already known."""
    size = F.col("shot_end_ms") - F.col("shot_start_ms")
    pairs = interval_join(
        anchors.select("match_id", "anchor_id", "status", "search_start_ms", "after_ms"),
        shots.where(size.between(2_500, 45_000)).select("match_id", "shot_start_ms", "shot_end_ms"),
        ["match_id"], ("search_start_ms", "after_ms"), ("shot_start_ms", "shot_end_ms"),
    )
    made = pairs.select(
        "match_id", F.concat_ws("-", F.lit("score-shot"), "anchor_id", F.col("shot_start_ms").cast("string"), F.col("shot_end_ms").cast("string")).alias("moment_id"),
        F.col("anchor_id").alias("story_id"), F.when(F.col("status") == "reversed", "disallowed_goal").otherwise("goal").alias("event_type"),
        F.col("shot_start_ms").alias("start_ms"), F.col("shot_end_ms").alias("end_ms"),
    )
    return made.join(moments.select("match_id", "moment_id"), ["match_id", "moment_id"], "left_anti")


def reviewed_window() -> Column:
    """The interval is already an exact, fully proven reviewed window (``window_exact``)."""
    return is_true("semantic_verified") & is_true("action_complete") & is_true("window_exact")


def trim_views(moments: DataFrame) -> DataFrame:
    """End a complete split view half a second after its result."""
    end = F.least("end_ms", F.greatest("payoff_end_ms", F.coalesce("proof_end_ms", "payoff_end_ms")) + 500)
    ok = (
        is_true("view_split") & is_true("semantic_verified") & is_true("action_complete") & is_true("proof_verified")
        & (F.col("payoff_end_ms") > F.col("contact_ms")) & (F.col("payoff_end_ms") <= F.col("end_ms"))
        & (F.col("end_ms") - end >= 150) & (end - F.col("start_ms") >= 2_500)
    )
    ok = F.coalesce(ok, F.lit(False))
    return moments.withColumn("trimmed", ok).withColumn("end_ms", F.when(ok, end).otherwise(F.col("end_ms")))


def trim_to_origin(moments: DataFrame) -> DataFrame:
    """Drop lead-in before the verified origin of an unlocked action."""
    start = F.greatest("start_ms", F.col("origin_ms") - F.when(replay(), 100).otherwise(1_200))
    ok = (
        ~is_true("selection_locked") & ~reviewed_window() & ~reaction() & (F.col("origin_ms") > F.col("start_ms"))
        & (start > F.col("start_ms") + 500) & (F.col("end_ms") - start >= 3_000)
    )
    ok = F.coalesce(ok, F.lit(False))
    return moments.withColumn("trimmed", ok).withColumn("start_ms", F.when(ok, start).otherwise(F.col("start_ms")))


def containing_shot(rows: DataFrame, shots: DataFrame, at: str, prefix: str) -> DataFrame:
    """Add the start and end of the earliest shot holding instant ``at`` (ends inclusive)."""
    points = rows.where(F.col(at).isNotNull()).select("match_id", "moment_id", F.col(at).alias("_p"), (F.col(at) + 1).alias("_q"))
    spans = shots.select("match_id", F.col("shot_start_ms").alias("_s"), (F.col("shot_end_ms") + 1).alias("_e"))
    hit = interval_join(points, spans, ["match_id"], ("_p", "_q"), ("_s", "_e"))
    first = hit.groupBy("match_id", "moment_id").agg(F.min(F.struct("_s", "_e")).alias("_h"))
    return rows.join(first, ["match_id", "moment_id"], "left").select(
        *rows.columns, F.col("_h._s").alias(f"{prefix}_start_ms"), (F.col("_h._e") - 1).alias(f"{prefix}_end_ms")
    )


def align_to_shots(moments: DataFrame, shots: DataFrame) -> DataFrame:
    """Correct action boundaries from the shots holding the origin and the payoff."""
    ready = ~is_true("selection_locked") & ~reviewed_window() & (
        (F.col("event_type") == "goal") | F.col("event_type").isin(*PHASE_EVENTS)
    )
    cols = ["match_id", "moment_id", "start_ms", "end_ms", "origin_ms", "contact_ms", "payoff_end_ms", "event_type", "tracking_decision", "is_replay", "story_phase"]
    rows = containing_shot(moments.where(ready).select(*cols), shots, "contact_ms", "touch")
    stale = (
        replay() & (F.abs(F.col("origin_ms") - F.col("start_ms")) <= 150) & (F.col("contact_ms") - F.col("origin_ms") > 3_000)
        & (F.col("touch_start_ms") > F.col("origin_ms") + 1_000)
    )
    rows = rows.withColumn("moved", F.coalesce(stale, F.lit(False))).withColumn(
        "from_ms", F.when(F.col("moved"), F.col("touch_start_ms")).otherwise(F.col("origin_ms"))
    )
    rows = containing_shot(containing_shot(rows, shots, "from_ms", "first"), shots, "payoff_end_ms", "last")
    usable = (
        (F.col("from_ms") <= F.col("contact_ms")) & (F.col("contact_ms") < F.col("payoff_end_ms"))
        & F.col("first_start_ms").isNotNull() & (F.col("last_start_ms") >= F.col("first_start_ms"))
    )
    is_goal = F.col("event_type") == "goal"
    lead = F.when(is_goal & replay(), 100).otherwise(1_200)
    base = F.when(F.col("moved"), F.col("from_ms")).otherwise(F.greatest("first_start_ms", F.col("from_ms") - lead))
    goal_start = F.greatest("start_ms", base)
    goal_end = F.least("end_ms", F.col("payoff_end_ms") + F.when(replay(), 650).otherwise(1_150))
    goal_ok = (
        ((goal_start > F.col("start_ms") + 40) | (goal_end < F.col("end_ms") - 40))
        & (goal_start <= F.col("contact_ms") - 1_000) & (goal_end - goal_start >= 3_000)
    )
    failed = F.coalesce(
        F.col("tracking_decision").rlike(
            "incomplete_action_phases|ball_not_visibly_continuous|unstable_camera|insufficient_joint_framing|keyframe_(?:opening|contact|ball_flight|payoff)"
        ), F.lit(False))
    clipped = (F.col("contact_ms") >= F.col("end_ms") - 450) | (F.col("payoff_end_ms") >= F.col("end_ms") - 120)
    other_ok = (
        (failed | clipped) & (F.col("end_ms") >= F.col("contact_ms") + 700) & (F.col("end_ms") - base >= 3_000)
        & (F.abs(base - F.col("start_ms")) > 40)
    )
    fixed = rows.where(F.coalesce(usable & F.when(is_goal, goal_ok).otherwise(other_ok), F.lit(False))).select(
        "match_id", "moment_id", F.when(is_goal, goal_start).otherwise(base).alias("new_start_ms"),
        F.when(is_goal, goal_end).otherwise(F.col("end_ms")).alias("new_end_ms"), F.col("moved").alias("origin_moved"),
        F.col("first_start_ms").alias("shot_start_ms"), F.col("last_end_ms").alias("shot_end_ms"),
    )
    return fixed


def extend_to_result(moments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Push the end through the latest reviewed phase plus a short tail."""
    times = [F.col(c) for c in ("rel_contact_ms", "rel_flight_ms", "rel_payoff_start_ms", "rel_payoff_end_ms")]
    rows = moments.join(reviews, ["match_id", "moment_id"], "left")
    last = F.greatest(*times)
    tail = F.when(F.col("event_type").isin(*SCORING), 800).otherwise(550)
    end = F.least("limit_ms", F.col("start_ms") + last + tail)
    late_touch = F.coalesce(end < F.col("start_ms") + F.col("rel_contact_ms") + 550, F.lit(False))
    ok = (
        ~is_true("view_split") & F.col("event_type").isin(*SHOTS) & last.isNotNull() & (end > F.col("end_ms") + 80) & ~late_touch
    )
    ok = F.coalesce(ok, F.lit(False))
    return rows.withColumn("extended", ok).withColumn("end_ms", F.when(ok, end).otherwise(F.col("end_ms")))


def review_windows(moments: DataFrame, sources: DataFrame) -> DataFrame:
    """Footage to review per moment: exact, with a result tail, or through companions.

    Companions only contribute their latest end, so they are reduced to one row
    per story and start time before the range join.
    """
    fixed = is_true("view_split") | is_true("selection_locked")
    passing = F.col("event_type").isin("assist", "skill", "dribble", "tackle", "free_kick", "normal_play")
    wide = ~fixed & ~passing & F.col("event_type").isin(*SCORING) & ~replay() & ~is_true("score_observation")
    tail = ~fixed & (passing | (F.col("event_type").isin(*SCORING) & ~replay() & is_true("score_observation")))
    rows = moments.select("match_id", "moment_id", "story_id", "start_ms", "end_ms", wide.alias("wide"), tail.alias("tail"))
    starts = moments.groupBy("match_id", "story_id", F.col("start_ms").alias("c_ms")).agg(F.max("end_ms").alias("c_end"))
    near = interval_join(
        rows.where("wide").withColumn("upto", F.col("end_ms") + 12_001), starts.withColumn("c_next", F.col("c_ms") + 1),
        ["match_id", "story_id"], ("start_ms", "upto"), ("c_ms", "c_next"),
    ).groupBy("match_id", "moment_id").agg(F.max("c_end").alias("far"))
    out = rows.join(near, ["match_id", "moment_id"], "left").join(sources.select("match_id", "duration_ms"), "match_id")
    end = F.when(F.col("wide"), F.least("duration_ms", F.greatest("end_ms", "far"))).when(
        F.col("tail"), F.least("duration_ms", F.col("end_ms") + 2_000)).otherwise(F.col("end_ms"))
    return out.select("match_id", "moment_id", "start_ms", end.alias("end_ms"))


def outcome_windows(moments: DataFrame, sources: DataFrame) -> DataFrame:
    """Detail window around contact and payoff: 48-image budget, even-pixel crop."""
    rows = moments.join(sources.select("match_id", "width", "height"), "match_id")
    whole = is_true("view_split") & (length_ms() <= 12_000)
    lo = F.when(~whole & F.col("contact_ms").isNotNull(), F.greatest("start_ms", F.least(F.col("end_ms") - 10, F.col("contact_ms") - 1_500))).otherwise(F.col("start_ms"))
    hi = F.when(~whole & (F.col("payoff_end_ms") > lo), F.least("end_ms", F.col("payoff_end_ms") + 600)).otherwise(F.col("end_ms"))
    boxed = (F.col("box_x1") >= 0) & (F.col("box_y1") >= 0) & (F.col("box_x2") <= 1) & (F.col("box_y2") <= 1) & (F.col("box_x2") > F.col("box_x1")) & (F.col("box_y2") > F.col("box_y1"))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.col("box_x2") - F.col("box_x1") + 0.24))
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.8), F.col("box_y2") - F.col("box_y1") + 0.4))
    x = F.greatest(F.lit(0.0), F.least(1 - w, (F.col("box_x1") + F.col("box_x2")) / 2 - w / 2))
    y = F.greatest(F.lit(0.0), F.least(1 - h, (F.col("box_y1") + F.col("box_y2")) / 2 - h / 2))
    even = lambda c: F.when(boxed, F.floor(c / 2) * 2)
    return rows.select(
        "match_id", "moment_id", lo.alias("from_ms"), F.least("end_ms", F.greatest(lo + 10, hi)).alias("to_ms"),
        F.round(F.least(F.lit(8.0), 48_000 / F.greatest(F.lit(10), hi - lo)), 4).alias("fps"),
        even(x * F.col("width")).alias("crop_x"), even(y * F.col("height")).alias("crop_y"),
        even(w * F.col("width")).alias("crop_w"), even(h * F.col("height")).alias("crop_h"),
    )


def blocked_windows(moments: DataFrame, shots: DataFrame, sources: DataFrame) -> DataFrame:
    """Context around a blocked scene, enlarged to touching shots, one row per local shot."""
    spans = shots.select("match_id", "shot_start_ms", "shot_end_ms")
    touch = (
        interval_join(moments.select("match_id", "moment_id", "start_ms", "end_ms"), spans, ["match_id"], ("start_ms", "end_ms"), ("shot_start_ms", "shot_end_ms"))
        .groupBy("match_id", "moment_id", "start_ms", "end_ms").agg(F.min("shot_start_ms").alias("t0"), F.max_by("shot_end_ms", "shot_start_ms").alias("t1"))
        .join(sources.select("match_id", "duration_ms"), "match_id")
        .select("match_id", "moment_id", F.greatest(F.lit(0), F.least(F.col("start_ms") - 2_000, F.col("t0"))).alias("win_start_ms"),
                F.least("duration_ms", F.greatest(F.col("end_ms") + 2_000, F.col("t1"))).alias("win_end_ms"))
    )
    local = interval_join(touch, spans, ["match_id"], ("win_start_ms", "win_end_ms"), ("shot_start_ms", "shot_end_ms"))
    return local.select(
        "match_id", "moment_id", "win_start_ms", "win_end_ms",
        (F.greatest("win_start_ms", "shot_start_ms") - F.col("win_start_ms")).alias("local_start_ms"),
        (F.least("win_end_ms", "shot_end_ms") - F.col("win_start_ms")).alias("local_end_ms"),
    )


def reel_manifest(clips: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Offset of each clip when the clips of a key are joined end to end."""
    out = scan(clips, keys, order, block, prior={"reel_start_ms": ("sum", F.col("length_ms"))})
    return out.withColumn("reel_end_ms", F.col("reel_start_ms") + F.col("length_ms"))


def timeline_tiling(phases: DataFrame, fps: float = 8.0) -> DataFrame:
    """Whether a scene's phases tile it exactly; point and inclusive ends are decoded first.

    A timeline holds at most 64 phases, so the window per scene is small.
    """
    w = Window.partitionBy("match_id", "moment_id").orderBy("phase_no")
    tick = 1000 / fps
    nxt = F.lead("p_start_ms").over(w)
    decode = (F.col("p_end_ms") == F.col("p_start_ms")) | (F.coalesce(nxt, F.col("scene_end_ms")) - F.col("p_end_ms") == tick)
    rows = phases.withColumn("d_end_ms", F.when(decode, F.least(F.col("scene_end_ms").cast("double"), F.col("p_end_ms") + tick)).otherwise(F.col("p_end_ms").cast("double")))
    prev = F.coalesce(F.lag("d_end_ms").over(w), F.col("scene_start_ms").cast("double"))
    ok = (F.abs(F.col("p_start_ms") - prev) <= 1) & (F.col("d_end_ms") > F.col("p_start_ms")) & (F.col("d_end_ms") <= F.col("scene_end_ms") + 1)
    return rows.withColumn("ok", ok).groupBy("match_id", "moment_id").agg(
        F.count(F.lit(1)).alias("phases"),
        (F.bool_and("ok") & (F.abs(F.max_by("d_end_ms", "phase_no") - F.max("scene_end_ms")) <= 1)).alias("tiles"),
    )


def output_clock(moments: DataFrame, block: Column) -> DataFrame:
    """Place selected scenes on the output clock: rate, freeze hold and transition overlap."""
    rate = F.greatest(F.lit(0.72), F.least(F.lit(1.0), F.coalesce("playback_rate", F.lit(1.0))))
    hold = F.when(F.col("effect") == "freeze_analysis", F.greatest(F.lit(400), F.least(F.lit(1000), F.coalesce("freeze_ms", F.lit(650))))).otherwise(0)
    fade = F.greatest(F.lit(40), F.least(F.lit(360), F.coalesce("transition_ms", F.lit(40))))
    rows = moments.withColumn("edit_key", F.coalesce("edit_order", F.lit(0))).withColumn(
        "out_ms", F.floor(F.greatest(F.lit(0.0), length_ms() / rate)) + hold
    ).withColumn("fade_ms", fade)
    run = scan(rows, ["match_id"], ["edit_key", "ordinal"], block, prior={
        "_before": ("sum", F.col("out_ms")), "_n": ("count", F.lit(1)), "_fades": ("sum", F.col("fade_ms")),
        "_first": ("first", F.col("fade_ms"))})
    lost = F.when(F.col("_n") > 0, F.col("_fades") - F.col("_first") + F.col("fade_ms")).otherwise(0)
    start = F.col("_before") - lost
    return run.select("match_id", "moment_id", (F.col("_n") + 1).alias("slot"), start.alias("out_start_ms"), (start + F.col("out_ms")).alias("out_end_ms"))


def encoded_clock(cuts: DataFrame, batches: DataFrame, drift_ms: int = 120) -> DataFrame:
    """Put an encoder tail on the last cut of each contiguous batch, else report why not.

    A batch is a handful of cuts, so its window is small.
    """
    w = Window.partitionBy("match_id", "batch").orderBy("cut_no")
    expect = F.coalesce(F.lag(F.col("cut_start_ms") + F.col("cut_ms")).over(w), F.lit(0))
    rows = cuts.join(batches, ["match_id", "batch"]).withColumn(
        "_ok", (F.col("cut_ms") > 0) & (F.abs(F.col("cut_start_ms") - expect) <= 2)
    ).withColumn("_last", F.lead("cut_no").over(w).isNull())
    whole = Window.partitionBy("match_id", "batch")
    tail_ok = F.when(F.col("_last"), (F.abs(F.col("cut_start_ms") + F.col("cut_ms") - F.col("planned_ms")) <= 2) & (F.col("measured_ms") > F.col("cut_start_ms"))).otherwise(True)
    good = F.min((F.col("_ok") & tail_ok).cast("int")).over(whole) == 1
    problem = F.when(F.abs(F.col("measured_ms") - F.col("planned_ms")) > drift_ms, "clock_disagrees").when(~good, "cut_out_of_order")
    return rows.select(
        "match_id", "batch", "cut_no", "cut_start_ms",
        F.when(problem.isNull() & F.col("_last"), F.col("measured_ms") - F.col("cut_start_ms")).otherwise(F.col("cut_ms")).alias("cut_ms"),
        problem.alias("problem"),
    )


def locked_queue_check(queue: DataFrame, moments: DataFrame) -> DataFrame:
    """Differences between a saved queue and the locked scenes; empty when they agree."""
    now = moments.where(is_true("selection_locked")).select("match_id", "moment_id", "start_ms", "end_ms", "tracking_passed")
    both = queue.join(now, ["match_id", "moment_id"], "full_outer")
    issue = (
        F.when(F.col("q_start_ms").isNull(), "not_in_queue").when(F.col("start_ms").isNull(), "missing_scene")
        .when((F.col("start_ms") != F.col("q_start_ms")) | (F.col("end_ms") != F.col("q_end_ms")), "interval_changed")
        .when(~is_true("tracking_passed"), "pending")
    )
    return both.select("match_id", "moment_id", issue.alias("issue")).where("issue IS NOT NULL")


def sample_times(moments: DataFrame, maximum: int = 12) -> DataFrame:
    """Budgeted instants to inspect: edges, phase anchors +-1/8 s, then an even spread.

    Priorities are positions in one array per moment, so nothing is shuffled.
    """
    s, e = F.col("start_ms"), F.col("end_ms")
    cap = F.greatest(s, e - 10)
    anchors = [F.least(cap, F.greatest(s, F.col(c) + d)) for c in ("contact_ms", "payoff_start_ms", "payoff_end_ms") for d in (-125, 0, 125)]
    spread = [s + F.floor(F.greatest(F.lit(0), e - s - 10) * F.lit(i) / F.lit(maximum - 1)) for i in range(1, maximum)]
    ordered = F.array_distinct(F.array_compact(F.array(s, F.greatest(s, e - 50), *anchors, *spread)))
    return moments.where("end_ms > start_ms").select(
        "match_id", "moment_id", F.explode(F.array_sort(F.slice(ordered, 1, maximum))).alias("t_ms")
    )


def sample_windows(scenes: DataFrame, fps: int, most: int = 80) -> DataFrame:
    """Batches of at most ``most`` ticks per scene with two ticks of context on both sides."""
    n = F.ceil(F.col("length_ms") * fps / F.lit(1000) - 1e-9)
    rows = scenes.where("length_ms > 0").withColumn("n", n).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
    first = F.col("batch") * most
    size = F.least(F.lit(most), F.col("n") - first)
    return rows.select(
        "match_id", "moment_id", "batch", size.alias("ticks"), F.greatest(F.lit(0), F.floor((first - 2) * 1000 / F.lit(fps))).alias("from_ms"),
        F.least("length_ms", F.floor((first + size + 2) * 1000 / F.lit(fps))).alias("to_ms"))


# -- clocks of reviewed clips --------------------------------------------------

CLIP_CLOCKS = ["origin_ms", "contact_ms", "flight_ms", "handoff_ms", "payoff_start_ms", "payoff_end_ms"]
PLAY_EVENTS = [
    "goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance", "assist", "free_kick", "skill", "dribble", "tackle", "foul", "normal_play",
]


def fix_reel_clock(reviews: DataFrame) -> DataFrame:
    """Move review clocks from the reel to the clip when the numbers prove they are on the reel.

    Rows carry the clip's ``reel_start_ms`` and ``reel_end_ms``; everything is inside the row.
    """
    off, n = F.col("reel_start_ms"), F.col("reel_end_ms") - F.col("reel_start_ms")
    times = F.array_compact(F.array(*[F.col(c) for c in CLIP_CLOCKS]))
    fits = F.forall(times, lambda t: (t >= off - 20) & (t <= off + n + 50))
    out = F.size(F.filter(times, lambda t: t > n + 50))
    edge = F.coalesce(F.abs(F.col("origin_ms") - off) <= 20, F.lit(False))
    hit = (off > 0) & (n > 0) & fits & ((out >= 2) | (edge & (out >= 1)))
    shift = lambda c: F.when(F.col("_hit"), F.col(c) - F.col("reel_start_ms")).otherwise(F.col(c))
    also = [c for c in ("proof_start_ms", "proof_end_ms", "w_start_ms", "w_end_ms") if c in reviews.columns]
    rows = reviews.withColumn("_hit", hit)
    return rows.withColumns({c: shift(c) for c in [*CLIP_CLOCKS, *also]}).withColumnRenamed("_hit", "clock_moved")


def fix_result_hold(reviews: DataFrame) -> DataFrame:
    """Pull a phase end that overruns its window by at most one observed frame back to the proven result."""
    t = is_true
    c = F.col
    box = (c("box_x1") < c("box_x2")) & (c("box_y1") < c("box_y2")) & (c("box_x1") >= 0) & (c("box_y1") >= 0) & (c("box_x2") <= 1) & (c("box_y2") <= 1)
    over, rest = c("payoff_end_ms") - c("w_end_ms"), c("w_end_ms") - c("proof_end_ms")
    ok = (
        t("r_verified") & t("r_complete") & t("window_proven") & t("proof_verified") & (c("proof_event") == c("event_type")) & box & (over > 0) & (over <= 126)
        & (c("contact_ms") >= c("w_start_ms")) & (c("payoff_start_ms") >= c("contact_ms")) & (c("proof_start_ms") >= c("payoff_start_ms"))
        & (c("proof_end_ms") > c("proof_start_ms")) & (rest >= 0) & (rest <= 126))
    ok = F.coalesce(ok, F.lit(False))
    return reviews.withColumn("held", ok).withColumn("payoff_end_ms", F.when(F.col("held"), c("proof_end_ms")).otherwise(c("payoff_end_ms")))


def invalid_timing(reviews: DataFrame) -> DataFrame:
    """Reviews whose clocks are missing, outside the clip or out of order after both corrections."""
    rows = fix_result_hold(fix_reel_clock(reviews))
    c = F.col
    n = c("reel_end_ms") - c("reel_start_ms")
    need = [c(k) for k in ("origin_ms", "contact_ms", "payoff_start_ms", "payoff_end_ms")]
    gone = need[0].isNull() | need[1].isNull() | need[2].isNull() | need[3].isNull()
    times = F.array_compact(F.array(*[c(k) for k in CLIP_CLOCKS]))
    out = F.exists(times, lambda t: (t < -50) | (t > n + 50))
    order = (
        (c("contact_ms") < c("origin_ms") - 50) | (c("payoff_start_ms") < c("contact_ms") - 125) | (c("payoff_end_ms") <= c("payoff_start_ms")) | (c("payoff_end_ms") <= c("contact_ms") + 50))
    win = c("w_start_ms").isNotNull() & (
        (c("w_start_ms") < 0) | (c("w_end_ms") > n + 1) | (c("w_end_ms") <= c("w_start_ms")) | (c("contact_ms") < c("w_start_ms") - 1)
        | (c("payoff_start_ms") >= c("w_end_ms")) | (c("payoff_end_ms") > c("w_end_ms") + 1))
    bad = gone | out | F.coalesce(order, F.lit(False)) | F.coalesce(win, F.lit(False))
    live = is_true("r_verified") & is_true("r_complete") & c("event_type").isin(*PLAY_EVENTS)
    # a generator instead of a filter: a pushed-down filter would repeat both corrections for every clock it reads
    hit = F.when(live & (bad | c("reel_start_ms").isNull()), F.array(F.struct("match_id", "moment_id")))
    return rows.select(F.inline(hit))


def review_failures(reviews: DataFrame) -> DataFrame:
    """Reasons a crop review fails: missing flags and too little timed evidence, as a code list."""
    support = reaction()
    flags = [("passed", F.lit(True)), ("correct_subject", F.lit(True)), ("stable_camera", F.lit(True)), ("subject_core", support),
             ("ball_followed", ~support), ("setup_visible", ~support), ("contact_visible", ~support), ("outcome_visible", ~support)]
    codes = [F.when(need & ~is_true(c), F.lit(c)) for c, need in flags]
    phased = ~support & is_true("setup_seen") & is_true("contact_seen") & is_true("payoff_seen")
    codes.append(F.when((F.coalesce("observation_count", F.lit(0)) < 2) & ~phased, F.lit("timestamped_crop_evidence")))
    extra = F.filter("required", lambda r: ~F.array_contains("granted", r))
    return reviews.withColumn("missing", F.array_join(F.array_sort(F.array_union(F.array_compact(F.array(*codes)), extra)), ","))


# Events that are reviewed alone.
ALONE = ["goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance"]


def review_batches(moments: DataFrame, limit_ms: int = 45_000, most: int = 4, block_rows: int = 512) -> DataFrame:
    """Batches of moments in input order: decisive ones alone, others up to ``most`` and ``limit_ms`` together.

    Adds ``batch``, counted from 1 per match. A decisive moment closes the open batch, so what follows it does not
    depend on what came before: each run between decisive moments is folded alone. A run longer than ``block_rows`` is
    cut into blocks; a block is folded from every state in which the batch before it can be open (empty, or its last
    1 to ``most - 1`` moments), and the states are then chained over one row per block.
    """
    alone = is_true("score_observation") | is_true("additional_action") | F.coalesce(F.col("event_type").isin(*ALONE), F.lit(False))
    length = F.greatest(F.lit(500), F.col("end_ms") - F.col("start_ms"))
    rows = moments.select("match_id", "moment_id", "ordinal", alone.alias("alone"), length.alias("ms"))
    by_input = F.floor(F.col("ordinal") / 4096)
    counts = {"place": ("count", F.lit(1)), "run": ("sum", F.when(F.col("alone"), 1).otherwise(0))}
    rows = scan(rows, ["match_id"], ["ordinal"], by_input, upto=counts)
    quiet = rows.where("NOT alone").withColumn("blk", F.floor(F.col("place") / block_rows))  # full blocks but for a run's first and last
    item = F.struct("ordinal", "ms")
    packs = quiet.groupBy("match_id", "run", "blk").agg(F.sort_array(F.collect_list(item)).alias("q"))  # block_rows at most
    last = F.slice("q", F.greatest(F.lit(1), F.size("q") - most + 2), F.lit(most - 1))
    before = Window.partitionBy("match_id", "run").orderBy("blk")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("ms"), F.array().cast("array<bigint>").alias("opens"))

    def step(acc, r):
        fresh = (acc["n"] == 0) | (acc["n"] >= most) | (acc["ms"] + r["ms"] > limit_ms)
        return F.struct(F.when(fresh, 1).otherwise(acc["n"] + 1).alias("n"), F.when(fresh, r["ms"]).otherwise(acc["ms"] + r["ms"]).alias("ms"),
                        F.when(fresh, F.concat(acc["opens"], F.array(r["ordinal"]))).otherwise(acc["opens"]).alias("opens"))

    # every entry state of a block: j moments of the block before are in the open batch
    tails = packs.withColumn("tail", F.lag(last).over(before))
    entry = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: j)
    def from_state(j):
        kept = F.slice("tail", F.greatest(F.lit(1), F.size("tail") - j + 1), F.greatest(j, F.lit(1)))
        ms = F.when(j == 0, F.lit(0).cast("long")).otherwise(F.aggregate(kept, F.lit(0).cast("long"), lambda a, r: a + r["ms"]))
        state = F.struct(j.cast("int").alias("n"), ms.alias("ms"), F.array().cast("array<bigint>").alias("opens"))
        return F.aggregate("q", F.when(j >= most, F.struct(F.lit(most).alias("n"), F.lit(0).cast("long").alias("ms"), F.array().cast("array<bigint>").alias("opens"))).otherwise(state), step)

    first = F.aggregate("q", start, step)
    table = tails.withColumn("by_state", F.when(F.col("tail").isNull(), F.array(first)).otherwise(F.transform(entry, from_state)))
    # chain: one row per block holds the exit state of each entry state
    exits = table.groupBy("match_id", "run").agg(F.sort_array(F.collect_list(F.struct("blk", F.transform("by_state", lambda s: s["n"]).alias("to")))).alias("chain"))
    walk = F.aggregate("chain", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<blk:bigint,state:int>>").alias("out")),
                       lambda acc, b: F.struct(F.coalesce(F.get(b["to"], F.when(F.size(b["to"]) == 1, F.lit(0)).otherwise(acc["at"])), F.lit(0)).alias("at"),
                                               F.concat(acc["out"], F.array(F.struct(b["blk"].alias("blk"), F.when(F.size(b["to"]) == 1, F.lit(0)).otherwise(acc["at"]).alias("state")))).alias("out")),
                       lambda acc: acc["out"])
    states = exits.select("match_id", "run", F.explode(walk).alias("s")).select("match_id", "run", "s.blk", "s.state")
    opened = table.join(states, ["match_id", "run", "blk"]).select("match_id", F.explode(F.get("by_state", F.col("state"))["opens"]).alias("ordinal"), F.lit(1).alias("opens"))
    marked = rows.join(opened, ["match_id", "ordinal"], "left").withColumn("new", F.when(F.col("alone") | (F.col("opens") == 1), 1).otherwise(0))
    return scan(marked.drop("place", "run", "opens"), ["match_id"], ["ordinal"], by_input, upto={"batch": ("sum", F.col("new"))}).select("match_id", "moment_id", F.col("batch").cast("long").alias("batch"))
