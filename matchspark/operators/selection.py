"""Ranked and budgeted selection.

Budgets bound how many rows can ever be chosen, and that bound prunes the input
exactly before anything is collected for the order-dependent step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators.timeline import scan


def first_per_group(moments: DataFrame) -> DataFrame:
    """First row of each duplicate group in input order; ungrouped rows all stay."""
    grouped = F.coalesce(F.col("duplicate_group"), F.lit("")) != ""
    cols = moments.columns
    firsts = (
        moments.where(grouped).groupBy("match_id", "duplicate_group")
        .agg(F.min_by(F.struct(*cols), F.col("ordinal")).alias("_r")).select("_r.*")
    )
    return moments.where(~grouped).unionByName(firsts.select(*cols))


def pack_timeline(moments: DataFrame, target_ms: int) -> DataFrame:
    """Greedy fill by importance: skip what does not fit, stop within 3 s of the goal.

    Of all candidates with the same length, only the first ``goal // length`` in
    rank order can ever be placed, because once one of them fails to fit so does
    every later one. That keeps the ordered list per match bounded by the budget
    no matter how many candidates a match has.
    """
    goal = min(80_000, max(1_000, target_ms))
    length = F.col("end_ms") - F.col("start_ms")
    slim = moments.select("match_id", "moment_id", "ordinal", "duplicate_group", "start_ms", "end_ms", "importance", "confidence")
    cand = (
        first_per_group(slim).where("end_ms > start_ms AND confidence >= 0.5")
        .select("match_id", "moment_id", length.alias("len"), "importance", "start_ms", "ordinal")
    )
    rank = Window.partitionBy("match_id", "len").orderBy(F.desc("importance"), "start_ms", "ordinal")
    hard_cap = goal + 251  # a clip lasts at least 1 ms
    cand = (
        cand.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= hard_cap)
        .where(F.col("rn") <= F.floor(F.lit(goal + 250) / F.col("len")) + 1)
    )
    entry = F.struct((-F.col("importance")).alias("imp"), "start_ms", "ordinal", "moment_id", "len")
    state = F.struct(
        F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("ids")
    )

    def step(acc, row):
        fits = ~acc["full"] & (acc["used"] + row["len"] <= goal + 250)
        used = F.when(fits, acc["used"] + row["len"]).otherwise(acc["used"])
        return F.struct(
            used.alias("used"),
            (acc["full"] | (fits & (used >= goal - 3000))).alias("full"),
            F.when(fits, F.concat(acc["ids"], F.array(row["moment_id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    picked = (
        cand.groupBy("match_id").agg(F.sort_array(F.collect_list(entry)).alias("q"))
        .select("match_id", F.explode(F.aggregate("q", state, step)["ids"]).alias("moment_id"))
        .withColumn("_hit", F.lit(True))
    )
    return (
        moments.drop("selected").join(picked, ["match_id", "moment_id"], "left")
        .withColumn("selected", F.coalesce("_hit", F.lit(False))).drop("_hit")
    )


# -- ranking ------------------------------------------------------------------


def director_candidates(moments: DataFrame, limit: int = 180) -> DataFrame:
    """Eligible, distinct, then the most important, in source order."""
    from matchspark.operators.incidents import unique_evidence

    fit = S.is_true("selection_locked") | (
        S.kept() & S.not_false("semantic_verified") & ~S.deferred() & (S.is_true("semantic_verified") | (F.col("confidence") >= 0.4))
    )
    ok = moments.where(fit)
    left = ok.join(unique_evidence(ok), ["match_id", "moment_id"], "left_semi")
    rank = Window.partitionBy("match_id").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "ordinal")
    return left.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= limit)


def rank_incidents(moments: DataFrame) -> DataFrame:
    """Incidents ordered by their best priority plus importance; reaction-only ones dropped."""
    ok = moments.where(S.not_false("semantic_verified") & S.not_false("action_complete"))
    worth = S.lookup(S.INCIDENT_PRIORITY, F.col("event_type"), 0) + F.coalesce("importance", F.lit(0.0))
    per = ok.groupBy("match_id", S.story().alias("story")).agg(
        F.max(worth).alias("priority"), F.min("ordinal").alias("first"), F.bool_or(~S.reaction()).alias("action"), F.count(F.lit(1)).alias("scenes")
    ).where("action")
    order = Window.partitionBy("match_id").orderBy(F.desc("priority"), "first")
    return per.select("match_id", "story", "priority", "scenes", F.row_number().over(order).alias("rank"))


def story_score(moments: DataFrame) -> DataFrame:
    """Score per story: its top eight by importance, phases present and visible rows; the best is flagged."""
    kept = moments.where(S.kept())
    rank = Window.partitionBy("match_id", "story").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "ordinal")
    rows = kept.withColumn("story", S.story())
    top = rows.withColumn("rn", F.row_number().over(rank)).where("rn <= 8").groupBy("match_id", "story").agg(F.sum(F.coalesce("importance", F.lit(0.0))).alias("best"))
    listed = F.when(F.col("story_phase").isin("build_up", "action", "payoff", "replay", "reaction"), F.col("story_phase"))
    both = S.is_true("ball_visible") & S.is_true("player_visible")
    facts = rows.groupBy("match_id", "story").agg(
        F.countDistinct(listed).alias("phases"), F.count(F.when(both, 1)).alias("visible"), F.min("ordinal").alias("first"))
    scored = top.join(facts, ["match_id", "story"]).withColumn("score", F.col("best") + F.col("phases") * 18 + F.col("visible") * 8)
    win = scored.groupBy("match_id").agg(F.max(F.struct("score", -F.col("first"))).alias("w")).select("match_id", F.col("w.score").alias("top"), (-F.col("w.col2")).alias("top_first"))
    return scored.join(win, "match_id").select("match_id", "story", "score", ((F.col("score") == F.col("top")) & (F.col("first") == F.col("top_first"))).alias("strongest"))


def chapter_order(moments: DataFrame) -> DataFrame:
    """Story chapters by first appearance; inside one, live, then replay, then reaction."""
    rows = moments.withColumn("story", S.story())
    first = rows.groupBy("match_id", "story").agg(F.min("start_ms").alias("chapter_ms"), F.min("ordinal").alias("chapter_ord"))
    phase = F.when(S.reaction(), 2).when(S.replay(), 1).otherwise(0)
    full = rows.withColumn("phase_rank", phase).join(first, ["match_id", "story"])
    order = ["chapter_ms", "chapter_ord", "phase_rank", "start_ms", "ordinal"]
    placed = scan(full, ["match_id"], order, F.struct("chapter_ms", "chapter_ord", "phase_rank", F.floor(F.col("start_ms") / 1_000).alias("s")), upto={"position": ("count", F.lit(1))})
    return placed.select("match_id", "moment_id", "story", "phase_rank", "position")


def view_quality() -> Column:
    """Additive quality of one camera view. Uses ``shot_ids`` when present."""
    t = lambda c, n: F.when(c, n).otherwise(0)
    return (
        t(S.is_true("semantic_verified"), 120) + t(S.is_true("action_complete"), 90) + t(S.is_true("ball_visible"), 35)
        + t(S.is_true("player_visible"), 30) + t(F.col("contact_ms").isNotNull(), 18) + t(F.col("proof_start_ms").isNotNull(), 18)
        + F.coalesce("visual_clarity", F.lit(0.0)) * 28 + F.coalesce("completeness", F.lit(0.0)) * 22
        + F.coalesce("confidence", F.lit(0.0)) * 20 + F.coalesce("importance", F.lit(0.0)) * 0.12
        - F.greatest(F.lit(0), F.coalesce("shot_count", F.lit(1)) - 1) * 12
    )


def limit_views(moments: DataFrame) -> DataFrame:
    """Keep the best goal view of a story, or the best two without a fixed live-first policy."""
    goal = F.col("event_type").isin(*S.SCORING) & S.kept()
    pool = moments.where(goal).withColumn("story", S.story()).withColumn("q", view_quality())
    rank = Window.partitionBy("match_id", "story").orderBy(F.desc(F.when(S.is_true("angle_selected"), 1).otherwise(0)), F.desc("q"), "start_ms", "ordinal")
    fixed = pool.groupBy("match_id", "story").agg(F.bool_or(S.is_true("live_first")).alias("fixed"))
    best = pool.withColumn("rn", F.row_number().over(rank)).where("rn <= 2").join(fixed, ["match_id", "story"]).where("rn = 1 OR NOT fixed")
    keep = best.select("match_id", "moment_id", F.lit(True).alias("_keep"))
    drop = goal & F.col("_keep").isNull()
    return moments.join(keep, ["match_id", "moment_id"], "left").withColumn("removed", drop).drop("_keep")


def pick_clear_angle(moments: DataFrame, segments: DataFrame) -> DataFrame:
    """Rank the views of each incident: verified, live, fewest cuts, earliest, clearest.

    ``segments`` holds the number of camera shots per moment.
    """
    anchored = S.is_true("score_observation")
    extra = S.is_true("additional_action")
    scoring = F.col("event_type").isin(*S.SCORING)
    apt = (
        (anchored | extra) & F.col("event_type").isin(*ACTIONS) & ~(anchored & ~scoring) & ~(extra & ~anchored & scoring)
        & S.is_true("action_complete") & S.not_false("semantic_verified") & S.kept()
    )
    rows = moments.where(apt).withColumn("story", S.story()).join(segments, ["match_id", "moment_id"], "left").select(
        "match_id", "story", "moment_id", F.when(S.is_true("semantic_verified"), 0).otherwise(1).alias("o1"),
        F.when(S.replay(), 1).otherwise(0).alias("o2"), F.greatest(F.lit(1), F.coalesce("cuts", F.lit(1))).alias("o3"), F.col("start_ms").alias("o4"),
        (-F.coalesce("visual_clarity", F.lit(0.0))).alias("o5"), (-F.coalesce("confidence", F.lit(0.0))).alias("o6"), "ordinal",
    )
    block = F.struct("o1", "o2", "o3", F.floor(F.col("o4") / 1_000).alias("s"))
    ranked = scan(rows, ["match_id", "story"], ["o1", "o2", "o3", "o4", "o5", "o6", "ordinal"], block, upto={"rank": ("count", F.lit(1))})
    return ranked.select("match_id", "story", "moment_id", "rank", (F.col("rank") == 1).alias("primary"))


ACTIONS = [
    "goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance", "tackle", "free_kick", "normal_play", "assist", "dribble",
]


def pick_tracked_angle(moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Best usable tracked view per locked goal story; the others carry a reason."""
    pool = moments.where(S.is_true("selection_locked") & F.col("event_type").isin(*S.SCORING)).withColumn("story", S.story())
    rated = pool.join(evidence, ["match_id", "moment_id"], "left")
    order = F.struct((-F.coalesce("quality", F.lit(float("-inf")))).alias("a"), (-view_quality()).alias("b"), F.col("start_ms").alias("c"), F.col("ordinal").alias("d"))
    win = rated.where("usable").groupBy("match_id", "story").agg(F.min_by("moment_id", order).alias("winner"))
    return pool.join(win, ["match_id", "story"], "left").select(
        "match_id", "story", "moment_id", F.coalesce(F.col("winner") == F.col("moment_id"), F.lit(False)).alias("chosen"),
        F.when(F.col("winner") == F.col("moment_id"), "best_tracked_incident_angle").when(F.col("winner").isNotNull(), "removed_after_incident_angle_comparison")
        .otherwise("incident_has_no_verified_angle").alias("decision"),
    )


def preflight_angles(moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """approved, backup or rejected for each locked scene before the lock is final."""
    locked = moments.where(S.is_true("selection_locked")).join(evidence, ["match_id", "moment_id"], "left").withColumn("story", S.story())
    ok = F.coalesce("usable", F.lit(False))
    goal = F.col("event_type").isin(*S.SCORING)
    rank = F.when(S.is_true("angle_selected"), 1e6).otherwise(0.0) + F.coalesce("quality", F.lit(0.0))
    win = locked.where(goal & ok).groupBy("match_id", "story").agg(F.max_by("moment_id", F.struct(rank, -F.col("ordinal"))).alias("winner"))
    chosen = ok & (~goal | (F.col("winner") == F.col("moment_id")))
    return locked.join(win, ["match_id", "story"], "left").select(
        "match_id", "story", "moment_id",
        F.when(chosen, "approved").when(ok, "backup").otherwise("rejected").alias("decision"),
        (goal & F.col("winner").isNull()).alias("incident_missing"),
    )


def recover_native(moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """For goal stories without a usable view, the best complete native-frame view."""
    pool = moments.where(S.is_true("selection_locked") & F.col("event_type").isin(*S.SCORING)).withColumn("story", S.story()).join(
        evidence, ["match_id", "moment_id"], "left")
    done = pool.where("usable").select("match_id", "story").distinct()
    fit = S.is_true("semantic_verified") & S.is_true("action_complete") & S.not_false("ball_visible") & S.not_false("player_visible") & S.is_true("proof_verified")
    left = pool.where(fit).join(done, ["match_id", "story"], "left_anti")
    order = F.struct((-F.coalesce("quality", F.lit(float("-inf")))).alias("a"), F.col("start_ms").alias("b"), F.col("ordinal").alias("c"))
    return left.groupBy("match_id", "story").agg(F.min_by("moment_id", order).alias("moment_id"))


def scene_capacity() -> Column:
    """Milliseconds a unique scene can fill: slowed action plus a hold, or a short reaction."""
    d = F.greatest(F.lit(0), S.length_ms())
    return F.when(d <= 0, 0.0).when(S.reaction(), F.least(F.lit(3_000.0), d)).otherwise(F.least(F.lit(12_000.0), d / 0.72) + 1_000)


def section_quota(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Mandatory scenes plus, per section, ranked scenes until its budget is met.

    ``ranked`` carries ``section``, ``rank``, ``mandatory`` and ``capacity_ms``.
    """
    base = ranked.where("mandatory").groupBy("match_id", "section").agg(F.sum("capacity_ms").alias("have"))
    optional = ranked.where("NOT mandatory")
    run = scan(optional, ["match_id", "section"], ["rank"], F.floor(F.col("rank") / 256), prior={"before": ("sum", F.col("capacity_ms"))})
    ok = run.join(plan.select("match_id", "section", "requested_ms"), ["match_id", "section"]).join(base, ["match_id", "section"], "left")
    picked = ok.where(F.coalesce("have", F.lit(0)) + F.col("before") < F.col("requested_ms")).select("match_id", "moment_id", "section")
    return picked.unionByName(ranked.where("mandatory").select("match_id", "moment_id", "section"))


def schedule_tracking(groups: DataFrame, need: DataFrame, ratio_pct: int = 145) -> DataFrame:
    """Decisive groups first, then ranked ones until the target; the rest is reserve.

    ``groups`` carries ``rank``, ``decisive`` and ``covered_ms``.
    """
    base = groups.groupBy("match_id").agg(F.sum(F.when(F.col("decisive"), F.col("covered_ms")).otherwise(0)).alias("fixed"))
    run = scan(groups, ["match_id"], ["rank"], F.floor(F.col("rank") / 256), prior={
        "before": ("sum", F.when(~F.col("decisive"), F.col("covered_ms")).otherwise(0))})
    target = F.col("required_ms") * ratio_pct / 100
    ok = F.col("decisive") | (F.col("fixed") + F.col("before") < target)
    return run.join(base, "match_id").join(need, "match_id").select("match_id", "story", "rank", ok.alias("primary"))


def even_subset(beats: DataFrame, n: DataFrame) -> DataFrame:
    """``slots`` evenly spread beats per match; all of them when there are no more."""
    order = Window.partitionBy("match_id").orderBy("ordinal")  # a script holds a few dozen beats
    rows = beats.withColumn("i", F.row_number().over(order) - 1)
    size = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("len"))
    plan = size.join(n, "match_id").withColumn("slots", F.greatest(F.lit(1), F.col("slots")))
    idx = F.when(F.col("slots") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), lambda j: F.floor(j * (F.col("len") - 1) / (F.col("slots") - 1) + 0.5)))
    want = F.when(F.col("len") <= F.col("slots"), F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).otherwise(idx)
    picks = plan.select("match_id", F.explode(want).alias("i"))
    return picks.join(rows, ["match_id", "i"]).select("match_id", "beat_id", F.col("i").alias("position"))


def safe_zoom(keyframes: DataFrame) -> DataFrame:
    """Largest of the allowed zooms that keeps ball and player inside the margin for a whole scene."""
    seen = S.is_true("ball_in_frame") & S.is_true("player_in_frame") & F.col("bx").isNotNull() & F.col("b_y").isNotNull() & F.col("px").isNotNull() & F.col("p_y").isNotNull()
    lo = lambda a, b: F.min(F.when(seen, F.least(a, b)))
    hi = lambda a, b: F.max(F.when(seen, F.greatest(a, b)))
    g = keyframes.groupBy("match_id", "scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(seen, 1)).alias("k"), F.bool_or(F.col("scene_cut") & (F.col("t_ms") > 150)).alias("cut"),
        lo("bx", "px").alias("x0"), hi("bx", "px").alias("x1"), lo("b_y", "p_y").alias("y0"), hi("b_y", "p_y").alias("y1"),
    )
    mid = lambda a, b: S.clamp((F.col(a) + F.col(b)) / 2, 0.475, 0.525)
    g = g.withColumns(dict(cx=mid("x0", "x1"), cy=mid("y0", "y1")))
    fits = lambda z: (
        (F.col("x0") >= F.col("cx") - 0.5 / z + 0.055 / z) & (F.col("x1") <= F.col("cx") + 0.5 / z - 0.055 / z)
        & (F.col("y0") >= F.col("cy") - 0.5 / z + 0.055 / z) & (F.col("y1") <= F.col("cy") + 0.5 / z - 0.055 / z)
    )
    reason = (
        F.when((F.col("n") < 8) | F.col("cut"), "insufficient_continuous_tracking")
        .when((F.col("k") < 8) | (F.col("k") / F.col("n") < 0.85), "ball_or_player_not_continuously_verified")
        .when((F.col("x0") < 0) | (F.col("x1") > 1) | (F.col("y0") < 0) | (F.col("y1") > 1), "invalid_subject_position")
    )
    zoom = F.when(reason.isNotNull(), 1.0).when(fits(1.10), 1.10).when(fits(1.08), 1.08).when(fits(1.05), 1.05).otherwise(1.0)
    return g.select("match_id", "scene_id", zoom.alias("zoom"), F.coalesce(reason, F.when(zoom > 1, "verified_scene_safe").otherwise("action_needs_full_width")).alias("reason"))


def repair_priority(moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """How much a local repair is worth; -1 when it cannot help."""
    goal = F.col("event_type") == "goal"
    z = lambda c: F.coalesce(c, F.lit(0.0))
    near = goal & (z("setup_direct") >= 0.45) & (z("contact_direct") >= 0.35) & (z("goal_payoff") >= 0.50)
    hopeless = (
        F.col("samples").isNull() | ~S.is_true("semantic_verified") | (z("max_step") > 0.08)
        | (z("setup_joint") < F.when(near, 0.45).otherwise(0.60)) | (z("contact_direct") < 0.20)
        | ((F.coalesce("flight_samples", F.lit(0)) > 0) & (z("flight_ball") < 0.50))
    )
    score = F.when(goal, 100).otherwise(0) + z("setup_joint") * 10 + z("contact_direct") * 10
    return moments.join(evidence, ["match_id", "moment_id"], "left").select("match_id", "moment_id", F.round(F.when(hopeless, -1.0).otherwise(score), 4).alias("priority"))


def fit_rate(segments: DataFrame, ceiling_ms: int) -> DataFrame:
    """Common rate multiplier in [1, 2] bringing the planned length under the ceiling.

    Bisection runs as a JVM fold over 32 steps on the selected segments, whose
    number the time budget bounds.
    """
    rate = lambda s, m: F.least(F.lit(1.18), F.greatest(F.lit(0.72), s["rate"] * m))
    cost = lambda s, m: F.least(F.lit(30_000.0), s["len"] / rate(s, m)) + s["extra"]
    total = lambda m: F.aggregate("segs", F.lit(0.0), lambda acc, s: acc + cost(s, m))
    hold = F.when(F.col("effect") == "freeze_analysis", F.least(F.lit(1000.0), F.greatest(F.lit(400.0), F.coalesce("freeze_ms", F.lit(650)).cast("double")))).otherwise(0.0)
    fade = F.least(F.lit(360.0), F.greatest(F.lit(40.0), F.coalesce("transition_ms", F.lit(40)).cast("double")))
    order = Window.partitionBy("match_id").orderBy("start_ms", "ordinal")
    rows = segments.where("end_ms > start_ms").withColumn("i", F.row_number().over(order))
    seg = F.struct("i", S.length_ms().cast("double").alias("len"), F.coalesce("playback_rate", F.lit(1.0)).alias("rate"), (hold - F.when(F.col("i") > 1, fade).otherwise(0.0)).alias("extra"))
    packs = rows.groupBy("match_id").agg(F.sort_array(F.collect_list(seg)).alias("segs"))
    init = F.struct(F.lit(1.0).alias("lo"), F.lit(2.0).alias("hi"))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        over = total(mid) > ceiling_ms
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), init, step)["hi"]
    m = F.when(total(F.lit(1.0)) <= ceiling_ms, 1.0).when(total(F.lit(2.0)) > ceiling_ms, 2.0).otherwise(found)
    return packs.withColumn("m", m).select("match_id", F.round("m", 4).alias("multiplier"), F.round(total(F.col("m")), 1).alias("planned_ms"))


def fit_selected(segments: DataFrame, target_ms: int) -> DataFrame:
    """Narrated scenes always; silent ones in edit order while they fit within 3 s of slack.

    ``est_ms`` is the estimated output length. Silent scenes of one length beyond
    ``budget // length`` can never fit, so the fold per match stays bounded.
    """
    told = F.coalesce(F.col("commentary"), F.lit("")) != ""
    base = segments.where(told).groupBy("match_id").agg(F.sum("est_ms").alias("told_ms"))
    limit = target_ms + 3_000
    same = Window.partitionBy("match_id", "est_ms").orderBy("edit_key", "start_ms", "ordinal")
    quiet = segments.where(~told & (F.col("est_ms") > 0)).withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= limit + 1).where(
        F.col("rn") <= F.floor(F.lit(limit) / F.col("est_ms")) + 1)
    packs = quiet.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("edit_key", "start_ms", "ordinal", "moment_id", "est_ms"))).alias("q"))
    start = F.struct(F.coalesce("told_ms", F.lit(0)).cast("long").alias("total"), F.array().cast("array<string>").alias("ids"))

    def step(acc, r):
        ok = acc["total"] + r["est_ms"] <= limit
        return F.struct(F.when(ok, acc["total"] + r["est_ms"]).otherwise(acc["total"]).alias("total"),
                        F.when(ok, F.concat(acc["ids"], F.array(r["moment_id"]))).otherwise(acc["ids"]).alias("ids"))

    extra = packs.join(base, "match_id", "left").select("match_id", F.explode(F.aggregate("q", start, step)["ids"]).alias("moment_id"))
    return segments.where(told).select("match_id", "moment_id").unionByName(extra)


def rank_backups(planned: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best relevance of each candidate to any planned scene of its match, 0 where nothing is planned.

    Only pairs that share a story or a word can score beyond the event's points, so pairs come from equi-joins on those;
    the event alone is counted per match and event, without pairs. Planned scenes also have analysis_purpose, screen_text
    and role (``reaction`` lets reactions stand in).
    """
    from matchspark.functions.text import EVIDENCE_WORDS, semantic_tokens

    keys = ["match_id", "moment_id"]
    p = planned.select(
        "match_id", F.col("moment_id").alias("p_id"), F.col("story_id").alias("p_story"), F.col("event_type").alias("p_event"), (S.reaction() | F.coalesce(F.col("role") == "reaction", F.lit(False))).alias("p_react"),
        F.concat_ws(" ", "description", "commentary", "analysis_purpose", "screen_text").alias("p_text"))
    c = candidates.select(*keys, "story_id", "event_type", S.reaction().alias("react"), "description")
    pt = p.select("match_id", "p_id", F.explode(semantic_tokens(F.col("p_text"))).alias("tok"))
    ct = c.select(*keys, F.explode(semantic_tokens(F.col("description"))).alias("tok"))
    points = F.when(F.col("tok").isin(*EVIDENCE_WORDS), 18).when(F.length("tok") >= 7, 10).otherwise(6)
    shared = pt.join(ct, ["match_id", "tok"]).groupBy(*keys, "p_id").agg(F.sum(points).alias("pts"))
    told = c.join(p.select("match_id", F.col("p_story").alias("story_id"), "p_id"), ["match_id", "story_id"]).select(*keys, "p_id", F.lit(0).cast("long").alias("pts"))
    pairs = shared.unionByName(told).groupBy(*keys, "p_id").agg(F.max("pts").alias("pts")).where("p_id <> moment_id")
    pairs = pairs.join(p.drop("p_text"), ["match_id", "p_id"]).join(c.drop("description"), keys)
    score = (
        F.when(F.col("p_story") == F.col("story_id"), 60).otherwise(0) + F.when(F.col("p_event") == F.col("event_type"), 8).otherwise(0)
        - F.when(F.col("react") & ~F.col("p_react"), 60).otherwise(0) + F.col("pts")
    )
    best = pairs.groupBy(*keys).agg(F.max(score).alias("best"))
    events = p.groupBy("match_id", F.col("p_event").alias("event_type")).agg(F.count("*").alias("same"), F.count(F.when(F.col("p_react"), 1)).alias("same_react"))
    own = p.select("match_id", F.col("p_id").alias("moment_id"), F.lit(1).alias("self")).distinct()
    rows = c.drop("description").join(events, ["match_id", "event_type"], "left").join(own, keys, "left").join(best, keys, "left")
    others = F.when(F.col("react"), F.col("same_react")).otherwise(F.col("same")) - F.coalesce("self", F.lit(0))
    alone = F.when(others > 0, 8).otherwise(0)
    return rows.select(*keys, F.greatest(F.lit(0), alone, F.coalesce("best", F.lit(0))).cast("long").alias("semantic_score"))
