"""Score history: samples, score changes with reversals, and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.scalar import (
    SCORING, deferred, is_true, kept, match_clock_seconds, not_false, reaction, replay, story,
)
from matchspark.operators.timeline import asof_within, block_of, fold, interval_join, islands, scan

TOP_SCORE = 20


def _int_score(c: str) -> Column:
    return F.coalesce(F.col(c).between(0, TOP_SCORE), F.lit(False))


def read_score_samples(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Readable samples of the matches whose sample ids are exactly the expected ones."""
    per_id = samples.groupBy("match_id", "sample_id").count()
    checked = expected.withColumn("_want", F.lit(1)).join(per_id, ["match_id", "sample_id"], "full_outer")
    bad = checked.where(F.col("_want").isNull() | F.col("count").isNull() | (F.col("count") > 1)).select("match_id").distinct()
    readable = (
        is_true("readable") & _int_score("home") & _int_score("away")
        & (F.trim(F.coalesce("home_label", F.lit(""))) != "") & (F.trim(F.coalesce("away_label", F.lit(""))) != "")
    )
    return samples.join(bad, "match_id", "left_anti").select(
        "match_id", "sample_id", "t_ms", readable.alias("readable"), F.when(readable, F.col("home")).alias("home"),
        F.when(readable, F.col("away")).alias("away"), F.coalesce("clock", F.lit("")).alias("clock"),
    )


STATE = """struct<n:bigint,first:struct<home:bigint,away:bigint>,prev:struct<t:bigint,home:bigint,away:bigint,clock:bigint>,
 anchors:array<struct<no:bigint,side:string,status:string,before_ms:bigint,after_ms:bigint,home:bigint,away:bigint,start_ms:bigint,end_ms:bigint>>,
 unresolved:array<struct<start_ms:bigint,end_ms:bigint,reason:string>>>""".replace("\n", "")
ANCHOR = STATE.split("anchors:array<")[1].split(">>,")[0] + ">"
GAP = "struct<start_ms:bigint,end_ms:bigint,reason:string>"


def score_ledger(samples: DataFrame, duration_ms: int) -> DataFrame:
    """One ledger per match: score changes, their reversals and what stays unexplained.

    A reading whose clock runs more than 2 s behind the last kept reading is a
    replayed scoreboard and is skipped; a kept reading without a clock switches
    that test off for the next one. A step of one opens an anchor, a step back
    reverses the latest open anchor that produced the score being left.

    A match holds at most one sample per sampling interval, so the ordered fold
    is bounded by its duration (540 rows for 90 minutes at 10 s).
    """
    usable = samples.where(is_true("readable") & _int_score("home") & _int_score("away")).where(F.col("t_ms").between(0, duration_ms))
    row = F.struct("sample_id", F.col("t_ms").alias("t"), "home", "away", match_clock_seconds(F.col("clock")).alias("clock"))
    init = F.struct(
        F.lit(0), F.lit(None), F.lit(None), F.array(), F.array()
    ).cast("struct<n:int,first:void,prev:void,anchors:array<void>,unresolved:array<void>>")
    init = F.expr(
        f"CAST(named_struct('n', 0L, 'first', NULL, 'prev', NULL, 'anchors', array(), 'unresolved', array()) AS {STATE})"
    )

    def step(s, r):
        p = s["prev"]
        skip = F.coalesce(r["clock"] < p["clock"] - 2, F.lit(False))
        dh, da = r["home"] - p["home"], r["away"] - p["away"]
        up = ((dh == 1) & (da == 0)) | ((da == 1) & (dh == 0))
        down = ((dh == -1) & (da == 0)) | ((da == -1) & (dh == 0))
        same = (dh == 0) & (da == 0)
        side = F.when(dh != 0, "home").otherwise("away")
        opened = F.struct(
            (F.size(s["anchors"]) + 1).alias("no"), side.alias("side"), F.lit("provisional").alias("status"),
            p["t"].alias("before_ms"), r["t"].alias("after_ms"), r["home"].alias("home"), r["away"].alias("away"),
            F.greatest(F.lit(0), p["t"] - 20_000).alias("start_ms"), F.least(F.lit(duration_ms), r["t"] + 20_000).alias("end_ms"),
        ).cast(ANCHOR)
        match = lambda a: (a["status"] != "reversed") & (a["side"] == side) & (a["home"] == p["home"]) & (a["away"] == p["away"])
        target = F.array_max(F.transform(F.filter(s["anchors"], match), lambda a: a["no"]))
        undone = F.transform(s["anchors"], lambda a: F.when(
            a["no"] == target,
            F.struct(a["no"].alias("no"), a["side"].alias("side"), F.lit("reversed").alias("status"), a["before_ms"].alias("before_ms"),
                     a["after_ms"].alias("after_ms"), a["home"].alias("home"), a["away"].alias("away"), a["start_ms"].alias("start_ms"),
                     F.least(F.lit(duration_ms), r["t"] + 10_000).alias("end_ms")).cast(ANCHOR)).otherwise(a))
        gap = lambda why: F.concat(s["unresolved"], F.array(F.struct(p["t"].alias("start_ms"), r["t"].alias("end_ms"), F.lit(why).alias("reason")).cast(GAP)))
        anchors = (
            F.when(p.isNull() | same, s["anchors"]).when(up, F.concat(s["anchors"], F.array(opened)))
            .when(down & target.isNotNull(), undone).otherwise(s["anchors"])
        )
        unresolved = (
            F.when(p.isNull() | same | up | (down & target.isNotNull()), s["unresolved"])
            .when(down, gap("unmatched_score_reversal")).otherwise(gap("multiple_or_inconsistent_score_change"))
        )
        nxt = F.struct(
            (s["n"] + 1).alias("n"), F.when(s["n"] == 0, F.struct(r["home"].alias("home"), r["away"].alias("away"))).otherwise(s["first"]).alias("first"),
            F.struct(r["t"].alias("t"), r["home"].alias("home"), r["away"].alias("away"), r["clock"].alias("clock")).alias("prev"),
            anchors.alias("anchors"), unresolved.alias("unresolved"),
        ).cast(STATE)
        return F.when(skip, s).otherwise(nxt)

    return fold(usable, ["match_id"], row, init, step, "ledger")


def ledger_anchors(ledger: DataFrame) -> DataFrame:
    return ledger.select("match_id", F.explode("ledger.anchors").alias("a")).select(
        "match_id", F.concat(F.lit("score-incident-"), F.col("a.no").cast("string")).alias("anchor_id"), "a.side", "a.status",
        "a.before_ms", "a.after_ms", "a.start_ms", "a.end_ms",
    )


def ledger_unresolved(ledger: DataFrame) -> DataFrame:
    return ledger.select("match_id", F.explode("ledger.unresolved").alias("u")).select("match_id", "u.start_ms", "u.end_ms", "u.reason")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    s = "ledger"
    zero = (F.col(f"{s}.n") >= 3) & (F.col(f"{s}.first.home") == 0) & (F.col(f"{s}.first.away") == 0)
    return ledger.select(
        "match_id", F.col(f"{s}.n").alias("readings"), F.size(f"{s}.anchors").alias("anchors"), F.size(f"{s}.unresolved").alias("unresolved"),
        (zero & (F.size(f"{s}.unresolved") == 0)).alias("complete"), F.col(f"{s}.prev.home").alias("home"), F.col(f"{s}.prev.away").alias("away"),
    )


def anchor_for_scene(moments: DataFrame, anchors: DataFrame) -> DataFrame:
    """The one score change each live scene belongs to, or null when none or several fit.

    A change owns the time after the previous change; the scene is placed by its
    proven, reviewed or contact clock, or by its whole interval without one.
    """
    block = block_of(F.col("after_ms"), 10_000)
    ends = scan(anchors, ["match_id"], ["after_ms", "anchor_id"], block, prior={"prev_ms": ("last", F.col("after_ms"))})
    owned = ends.select(
        "match_id", "anchor_id", "status", "after_ms", "prev_ms", F.greatest("search_start_ms", F.coalesce("prev_ms", "search_start_ms")).alias("lower_ms"),
        (F.col("after_ms") + 2).alias("upper_ms"),
    ).where("upper_ms > lower_ms")
    inside = lambda c, ok=F.lit(True): F.when(ok & F.col(c).between(F.col("start_ms"), F.col("end_ms")), F.col(c))
    clock = F.coalesce(
        inside("proof_start_ms", is_true("proof_verified")), inside("payoff_start_ms", is_true("semantic_verified")), inside("contact_ms")
    )
    live = moments.where(~replay()).select("match_id", "moment_id", "start_ms", "end_ms", clock.alias("clock_ms"))
    probe = live.withColumn("p_ms", F.coalesce("clock_ms", "start_ms")).withColumn("q_ms", F.col("p_ms") + 1)
    pairs = interval_join(probe, owned, ["match_id"], ("p_ms", "q_ms"), ("lower_ms", "upper_ms"))
    by_clock = F.col("prev_ms").isNull() | (F.col("clock_ms") > F.col("prev_ms") + 1)
    hit = pairs.where(F.when(F.col("clock_ms").isNotNull(), by_clock).otherwise(F.col("end_ms") <= F.col("after_ms") + 1))
    one = hit.groupBy("match_id", "moment_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("anchor_id").alias("anchor_id"), F.min("status").alias("anchor_status")
    ).where("_n = 1").drop("_n")
    return moments.join(one, ["match_id", "moment_id"], "left")


def score_coverage(moments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per score change: the type it requires and whether a verified scene shows it."""
    ok = moments.where(
        is_true("semantic_verified") & is_true("action_complete") & kept() & F.col("event_type").isin(*SCORING) & ~replay()
    )
    seen = anchor_for_scene(ok, anchors).where("anchor_id IS NOT NULL").groupBy("match_id", "anchor_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.bool_or(F.col("event_type") == "goal").alias("_goal"),
        F.bool_or(F.col("event_type") == "disallowed_goal").alias("_dis"),
    )
    undone = F.col("status") == "reversed"
    covered = F.coalesce(F.when(undone, F.col("_dis")).otherwise(F.col("_goal")), F.lit(False))
    return anchors.join(seen, ["match_id", "anchor_id"], "left").select(
        "match_id", "anchor_id", F.when(undone, "disallowed_goal").otherwise("goal").alias("required_type"), (~undone).alias("required"),
        covered.alias("covered"), F.coalesce("scenes", F.lit(0)).alias("scenes"),
    )


def stable_score(moments: DataFrame, samples: DataFrame, tol_ms: int = 25_000) -> DataFrame:
    """Live scenes with the same score read shortly before and after, on an advancing clock.

    Samples are in the order of time and ``ordinal``: the last one up to the setup and the first one from the end on count.
    """
    contact_lead = F.least(F.col("start_ms") + 1_000, F.col("contact_ms") - 250)
    ready = F.when(F.col("contact_ms") > F.col("start_ms"), contact_lead).otherwise(F.col("start_ms"))
    live = moments.where(~replay()).select("match_id", "moment_id", "start_ms", "end_ms", ready.alias("setup_ms"))
    first = asof_within(live, samples, ["match_id"], "setup_ms", "t_ms", tol_ms + 1_000, ["clock_s", "home", "away"], "before", ties=["ordinal"])
    both = asof_within(first, samples, ["match_id"], "end_ms", "t_ms", tol_ms, ["clock_s", "home", "away"], "after", ties=["ordinal"])
    ok = (
        (F.col("start_ms") - F.col("before_ms") <= tol_ms) & (F.col("after_ms") - F.col("end_ms") <= tol_ms)
        & (F.col("after_clock_s") > F.col("before_clock_s")) & (F.col("before_home") == F.col("after_home")) & (F.col("before_away") == F.col("after_away"))
    )
    return both.where(F.coalesce(ok, F.lit(False))).select("match_id", "moment_id", "before_ms", "after_ms")


def own_goals(moments: DataFrame, anchors: DataFrame, complete: DataFrame) -> DataFrame:
    """Pair proven live goals with score changes in order, all or nothing per match.

    Overlapping goals count as one; ``complete`` lists matches with a full history.
    """
    goals = moments.where(
        ~is_true("selection_locked") & (F.col("event_type") == "goal") & is_true("semantic_verified") & is_true("action_complete")
        & kept() & ~replay() & is_true("proof_verified") & F.col("proof_start_ms").between(F.col("start_ms"), F.col("end_ms"))
    ).select("match_id", "moment_id", "ordinal", "start_ms", "end_ms", "proof_start_ms")
    # more than .1 s of overlap joins a group: shrink ends so that the plain island test applies
    groups = islands(goals.withColumn("_e", F.col("end_ms") - 100), ["match_id"], "start_ms", "_e", ["ordinal"]).drop("_e")
    block = block_of(F.col("after_ms"), 10_000)
    order = scan(anchors, ["match_id"], ["after_ms", "anchor_id"], block, upto={"island": ("count", F.lit(1))}).select(
        "match_id", "island", "anchor_id", F.col("search_start_ms").alias("a0"), F.col("search_end_ms").alias("a1")
    )
    n_anchor = anchors.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_anchor"), F.bool_or(F.col("status") == "reversed").alias("undone"))
    n_goal = groups.groupBy("match_id").agg(F.max("island").alias("n_goal"))
    even = n_anchor.join(n_goal, "match_id").join(complete, "match_id", "left_semi").where("n_anchor = n_goal AND NOT undone").select("match_id")
    paired = groups.join(even, "match_id", "left_semi").join(order, ["match_id", "island"])
    stray = paired.where(~F.col("proof_start_ms").between(F.col("a0"), F.col("a1"))).select("match_id").distinct()
    return paired.join(stray, "match_id", "left_anti").select("match_id", "moment_id", "anchor_id", "island")


def overlap_groups(goals: DataFrame) -> DataFrame:
    """Group number of live goals overlapping by more than .1 s, in source order."""
    return islands(goals.withColumn("_e", F.col("end_ms") - 100), ["match_id"], "start_ms", "_e", ["ordinal"]).drop("_e")


def rebind_story(moments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Live goals take their score change as story; replays and reactions follow the nearest earlier goal."""
    scoring = F.col("event_type").isin(*SCORING) & ~replay()
    bound = anchor_for_scene(moments.where(scoring), anchors).where("anchor_id IS NOT NULL")
    live = bound.withColumn(
        "new_type", F.when(F.col("anchor_status") == "reversed", "disallowed_goal").otherwise(F.col("event_type"))
    ).select("match_id", "moment_id", "anchor_id", "new_type")
    seen = bound.where(is_true("semantic_verified") & is_true("action_complete") & kept()).groupBy("match_id", F.col("end_ms").alias("g_ms")).agg(
        F.max(F.struct(F.col("start_ms").alias("g_start"), "ordinal", F.col("moment_id").alias("goal_id"), "anchor_id", "anchor_status")).alias("g")
    )
    late = F.when(reaction(), 500).otherwise(100)
    followers = moments.where(replay() | reaction()).select(
        "match_id", "moment_id", "event_type", (F.col("start_ms") - 12_000).alias("f0"), (F.col("start_ms") + late + 1).alias("f1")
    )
    near = interval_join(followers, seen.withColumn("g_next", F.col("g_ms") + 1), ["match_id"], ("f0", "f1"), ("g_ms", "g_next"))
    linked = near.groupBy("match_id", "moment_id", "event_type").agg(F.max("g").alias("g")).select(
        "match_id", "moment_id", "g.anchor_id", "g.goal_id",
        F.when(F.col("event_type").isin(*SCORING) & (F.col("g.anchor_status") == "reversed"), "disallowed_goal").otherwise(F.col("event_type")).alias("new_type"),
    )
    change = live.withColumn("goal_id", F.lit(None).cast("string")).join(linked.select("match_id", "moment_id"), ["match_id", "moment_id"], "left_anti").unionByName(
        linked.select("match_id", "moment_id", "anchor_id", "new_type", "goal_id")
    )
    return moments.join(change, ["match_id", "moment_id"], "left").withColumns(
        dict(story_id=F.coalesce("anchor_id", "story_id"), event_type=F.coalesce("new_type", "event_type"))
    ).drop("new_type")


def _goal_stories(moments: DataFrame, verified_only: bool) -> DataFrame:
    alt = is_true("angle_selected") & is_true("semantic_verified") & is_true("score_observation")
    ok = (F.col("event_type") == "goal") & kept() & (~replay() | alt)
    if verified_only:
        ok = ok & is_true("semantic_verified") & is_true("action_complete") & ~deferred() & not_false("crosscheck_verified")
    return moments.where(ok)


def goal_story_count(moments: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct proven goal stories against the expected total."""
    n = _goal_stories(moments, True).groupBy("match_id").agg(F.countDistinct(story()).alias("observed"))
    rows = expected.join(n, "match_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    gap = F.col("expected") - F.col("observed")
    return rows.select(
        "match_id", "expected", "observed", F.coalesce(F.greatest(F.lit(0), gap), F.lit(0)).alias("missing"),
        F.coalesce(F.greatest(F.lit(0), -gap), F.lit(0)).alias("excess"), F.coalesce(gap == 0, F.lit(True)).alias("complete"),
    )


def drop_unproved_goals(existing: DataFrame, recovered: DataFrame, expected: DataFrame) -> DataFrame:
    """Once enough goal stories are known, recovered goals of other stories are dropped."""
    known = existing.where((F.col("event_type") == "goal") & kept() & is_true("semantic_verified") & ~replay()).select("match_id", story().alias("story")).distinct()
    full = (
        expected.where("expected IS NOT NULL").join(known.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")), "match_id", "left")
        .where(F.coalesce("n", F.lit(0)) >= F.col("expected")).select("match_id", F.lit(True).alias("_full"))
    )
    rows = recovered.withColumn("story", story()).join(full, "match_id", "left").join(known.withColumn("_known", F.lit(True)), ["match_id", "story"], "left")
    return rows.where(F.col("_full").isNull() | (F.col("event_type") != "goal") | F.col("_known").isNotNull()).drop("_full", "_known", "story")


def live_goal_found(moments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Score changes for which a complete live goal finishes no later than the change."""
    finish = F.when(is_true("proof_verified"), F.col("proof_start_ms")).otherwise(F.coalesce("contact_ms", "end_ms"))
    goals = moments.where(F.col("event_type").isin(*SCORING) & is_true("action_complete") & ~replay() & kept()).withColumn("f", finish)
    first = goals.where(F.col("f").between(F.col("start_ms"), F.col("end_ms"))).groupBy("match_id").agg(F.min("f").alias("first_finish"))
    found = F.coalesce(F.col("first_finish") <= F.col("after_ms") + 1, F.lit(False))
    return anchors.join(first, "match_id", "left").select("match_id", "anchor_id", found.alias("found"))


def recovery_needed(moments: DataFrame, anchors: DataFrame, expected: DataFrame, missing: DataFrame) -> DataFrame:
    """Kind and size of the search still needed per match."""
    cover = score_coverage(moments, anchors).groupBy("match_id").agg(
        F.bool_or("required").alias("any_live"), F.count(F.when(F.col("required") & ~F.col("covered"), 1)).alias("uncovered")
    )
    goals = goal_story_count(moments, expected).select("match_id", "complete")
    only = F.coalesce(F.col("any_live") & (F.col("uncovered") == 0) & F.col("complete"), F.lit(False))
    n = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), "missing_ms") / F.lit(15_000))))
    return missing.join(goals, "match_id").join(cover, "match_id", "left").select(
        "match_id", only.alias("duration_only"), n.alias("windows"), (F.col("missing_ms") > 50).alias("revisit_all")
    )


# Tracking decisions that prove a scene was shown.
VERIFIED_DECISIONS = [
    "phase_verified_goal", "native_frame_verified_goal", "native_frame_verified_action", "native_semantic_complete_action",
    "full_bleed_repaired", "verified_minimum_motion", "verified_decision_framing", "gemini_crop_verified", "hybrid_crop_verified",
]


def incident_coverage(moments: DataFrame) -> DataFrame:
    """Required incidents and whether the kept selection covers each."""
    sv = is_true("semantic_verified")
    req = moments.where(sv & F.col("event_type").isin("goal", "var", "offside", "disallowed_goal"))
    needs = req.groupBy("match_id", story().alias("story")).agg(
        F.count(F.lit(1)).alias("candidates"), F.bool_or(F.col("event_type") == "goal").alias("g"),
        F.bool_or(F.col("event_type") == "disallowed_goal").alias("d"),
    )
    shown = F.coalesce(F.col("tracking_decision").isin(*VERIFIED_DECISIONS), F.lit(False))
    sel = moments.where(sv & kept() & not_false("selected")).groupBy("match_id", story().alias("story")).agg(
        F.bool_or((F.col("event_type") == "goal") & is_true("action_complete") & shown & (~replay() | is_true("angle_selected"))).alias("has_g"),
        F.bool_or((F.col("event_type") == "disallowed_goal") & is_true("action_complete") & shown).alias("has_d"),
        F.bool_or(F.col("event_type").isin("offside", "var") & not_false("action_complete") & not_false("tracking_passed") & shown).alias("has_o"),
    )
    covered = F.when(F.col("g"), F.col("has_g")).when(F.col("d"), F.col("has_d")).otherwise(F.col("has_o"))
    return needs.join(sel, ["match_id", "story"], "left").select(
        "match_id", "story", F.when(F.col("g"), "goal").when(F.col("d"), "disallowed_goal").otherwise("decision").alias("kind"),
        "candidates", F.coalesce(covered, F.lit(False)).alias("covered"),
    )
