"""Quality metrics and verdicts.

A scene is one clip of bounded length sampled at a bounded rate, so windows and
exact percentiles per ``(match_id, scene_id)`` hold a bounded number of rows; a
large match is spread over its scenes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators.timeline import block_of, interval_join, scan

SCENE = ["match_id", "scene_id"]


def scene_window():
    return Window.partitionBy(*SCENE).orderBy("t_ms")


def ratio(cond: Column, base: Column | None = None) -> Column:
    """Share of rows where ``cond`` holds, among rows where ``base`` holds."""
    c = F.coalesce(cond, F.lit(False))
    hit = F.count(F.when(c if base is None else c & base, 1))
    n = F.count(F.lit(1)) if base is None else F.count(F.when(base, 1))
    return hit / F.greatest(F.lit(1), n)


def r4(c: Column) -> Column:
    """Four decimals; the nudge keeps exact ties from depending on float noise."""
    return F.round(c + 1e-9, 4)


# -- capacity and reports -----------------------------------------------------


def story_capacity(moments: DataFrame) -> DataFrame:
    """Milliseconds of distinct scenes a story can fill per match."""
    from matchspark.operators.incidents import unique_evidence
    from matchspark.operators.selection import scene_capacity

    left = moments.join(unique_evidence(moments), ["match_id", "moment_id"], "left_semi")
    return left.groupBy("match_id").agg(F.round(F.sum(scene_capacity()), 3).alias("capacity_ms"))


def render_capacity(moments: DataFrame, transition_ms: int = 80, reaction_ms: int = 3_000) -> DataFrame:
    """Distinct scenes capped at 30 s, reactions at their own cap, minus transitions."""
    from matchspark.operators.incidents import unique_evidence

    left = moments.join(unique_evidence(moments), ["match_id", "moment_id"], "left_semi").where("end_ms > start_ms")
    part = F.when(S.reaction(), F.least(F.lit(reaction_ms), S.length_ms())).otherwise(F.least(F.lit(30_000), S.length_ms()))
    return left.groupBy("match_id").agg(
        F.greatest(F.lit(0), F.sum(part) - (F.count(F.lit(1)) - 1) * transition_ms).alias("capacity_ms"))


def editable_seconds(moments: DataFrame) -> DataFrame:
    """Gameplay plus at most 18 s of reactions, each at its slowest legal rate."""
    gone = F.col("tracking_decision").isin("analysis_rejected", "not_tracked", "rejected_after_plan", "selection_locked_portrait_repair")
    d = S.length_ms().cast("double")
    at = lambda floor: F.least(F.lit(30_000.0), d / F.least(F.lit(1.18), F.greatest(F.lit(floor), d / 30_000)))
    ok = moments.where(S.not_false("semantic_verified") & S.kept() & ~F.coalesce(gone, F.lit(False)) & (d > 0))
    return ok.groupBy("match_id").agg(
        F.round(F.sum(F.when(~S.reaction(), at(0.72)).otherwise(0.0)) + F.least(F.lit(18_000.0), F.sum(F.when(S.reaction(), at(0.84)).otherwise(0.0))), 2).alias("editable_ms"))


# Fixed values.
REPAIRABLE = r"framing|camera|ball|goal_action|action_phases|keyframe_(?:opening|contact|ball_flight|payoff)"


def evidence_report(moments: DataFrame) -> DataFrame:
    """Rejected and framing-pending scenes with their reason and whether repair can help."""
    rej = moments.where(~S.kept()).select(
        "match_id", "moment_id", "semantic_verified", F.lit("rejected").alias("state"),
        F.coalesce("reject_reason", "tracking_decision", F.lit("analysis_rejected")).alias("reason"))
    pend = moments.where(S.is_true("selection_locked") & F.col("tracking_passed").eqNullSafe(F.lit(False))).select(
        "match_id", "moment_id", "semantic_verified", F.lit("framing_pending").alias("state"), F.coalesce("tracking_decision", F.lit("unverified_framing")).alias("reason"))
    both = rej.unionByName(pend)
    return both.select("match_id", "moment_id", "state", "reason", (S.is_true("semantic_verified") & F.col("reason").rlike(REPAIRABLE)).alias("repairable"))


COVERAGES = ["ball_cov", "player_cov", "joint_vis", "joint_fit_cov", "lock_cov", "highlight_cov"]


def tracking_summary(evidence: DataFrame) -> DataFrame:
    """Frame-weighted mean of the scene coverages per match."""
    n = F.coalesce("frames", F.lit(0))
    total = F.sum(n)
    return evidence.groupBy("match_id").agg(
        total.alias("frames"), *[r4(F.sum(F.coalesce(c, F.lit(0.0)) * n) / F.greatest(F.lit(1), total)).alias(c) for c in COVERAGES])


# -- frame ratios -------------------------------------------------------------


def phase_quality(keyframes: DataFrame, contact_ms: Column) -> DataFrame:
    """Visibility ratios per phase; contact is judged on the frames around the touch.

    Each frame is tagged with the phases it counts for, so one shuffle serves all.
    """
    near = F.col("t_ms").between(contact_ms - 300, contact_ms + 250)
    tags = F.array_compact(F.array(F.when(F.col("phase").isin("setup", "flight", "payoff"), F.col("phase")), F.when(near, F.lit("contact"))))
    rows = keyframes.withColumn("judged", F.explode(tags))
    b, d, j = F.col("ball_in_frame"), F.col("direct"), F.col("joint_fit")
    return rows.groupBy(*SCENE, "judged").agg(
        F.count(F.lit(1)).alias("samples"), r4(ratio(d & b)).alias("direct_ball"), r4(ratio(b)).alias("ball"), r4(ratio(j)).alias("joint"),
        r4(ratio(d & j)).alias("direct_joint"), r4(ratio(F.col("payoff_in_frame"))).alias("payoff"))


def longest_gap(records: DataFrame, first_step_ms: int = 100) -> DataFrame:
    """Longest time without a direct ball; the first sample counts one step."""
    w = scene_window()
    step = F.greatest(F.lit(1), F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(first_step_ms)))
    run = F.sum(F.when(F.col("direct"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = records.select(*SCENE, "direct", step.alias("step"), run.alias("run"))
    gaps = rows.groupBy(*SCENE, "run").agg(F.sum(F.when(~F.col("direct"), F.col("step")).otherwise(0)).alias("gap"))
    return gaps.groupBy(*SCENE).agg(F.max("gap").alias("gap_ms"))


def camera_metrics(keyframes: DataFrame) -> DataFrame:
    """Largest and 95th percentile step, 95th percentile jerk; cuts break the chain."""
    w = scene_window()
    move = F.when(~F.col("cut"), F.col("camera_x") - F.lag("camera_x").over(w))
    rows = keyframes.select(*SCENE, "t_ms", move.alias("move"))
    rows = rows.withColumn("jerk", F.abs(F.col("move") - F.lag("move").over(scene_window())))
    return rows.groupBy(*SCENE).agg(
        r4(F.coalesce(F.max(F.abs("move")), F.lit(0.0))).alias("max_step"), r4(F.coalesce(F.percentile(F.abs("move"), 0.95), F.lit(0.0))).alias("step_p95"),
        r4(F.coalesce(F.percentile("jerk", 0.95), F.lit(0.0))).alias("jerk_p95"))


def camera_reversals(keyframes: DataFrame) -> DataFrame:
    """Direction changes among visible steps, their rate, and abrupt jumps."""
    w = scene_window()
    move = F.when(~F.col("cut"), F.col("camera_x") - F.lag("camera_x").over(w))
    seen = keyframes.select(*SCENE, "t_ms", move.alias("move")).where(F.abs("move") >= 0.01)
    turn = F.signum("move") != F.lag(F.signum("move")).over(w)
    rows = seen.withColumn("turn", turn)
    n = F.count(F.lit(1))
    return rows.groupBy(*SCENE).agg(
        n.alias("moves"), F.count(F.when(F.col("turn"), 1)).alias("reversals"),
        r4(F.count(F.when(F.col("turn"), 1)) / F.greatest(F.lit(1), n - 1)).alias("rate"), F.count(F.when(F.abs("move") > 0.25, 1)).alias("jumps"))


def hybrid_geometry(records: DataFrame) -> DataFrame:
    """Phase ratios, opening carrier and hard violations of one crop path.

    Rows carry the crop (``x0, y0, x1, y1``), ball, player box, scene phase clocks and ``support_only``.
    """
    edge = lambda c, e, inner: F.when(c, 0.0).otherwise(inner)
    inside = lambda x, y: (
        (x >= F.col("x0") + F.when(F.col("x0") <= 0.000001, 0.0).otherwise(0.008)) & (x <= F.col("x1") - F.when(F.col("x1") >= 0.999999, 0.0).otherwise(0.008))
        & (y >= F.col("y0")) & (y <= F.col("y1"))
    )
    ball = F.coalesce(F.col("direct") & inside(F.col("ball_x"), F.col("ball_y")), F.lit(False))
    man = F.coalesce(F.col("track_id").isNotNull() & inside(F.col("px1"), F.col("ptop")) & inside(F.col("px2"), F.col("pbottom")), F.lit(False))
    w = scene_window()
    dt = (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000
    fast = F.coalesce(~F.col("cut") & (dt > 0) & (F.abs(F.col("camera_x") - F.lag("camera_x").over(w)) / dt > 0.352), F.lit(False))
    rows = records.withColumns(dict(ball=ball, man=man, fast=fast))
    near = F.col("t_ms").between(F.col("contact_ms") - 300, F.col("contact_ms") + 250)
    pay = F.col("t_ms").between(F.col("payoff_start_ms"), F.col("payoff_end_ms"))
    in_phase = {"setup": F.col("phase") == "setup", "contact": near, "flight": F.col("phase") == "flight", "payoff": pay}
    aggs = [F.count(F.when(c, 1)).alias(f"{p}_n") for p, c in in_phase.items()]
    aggs += [ratio(F.col("ball"), c).alias(f"{p}_ball") for p, c in in_phase.items()]
    aggs += [ratio(F.col("ball") & F.col("man"), c).alias(f"{p}_joint") for p, c in in_phase.items()]
    g = rows.groupBy(*SCENE).agg(
        *aggs, F.bool_or((F.col("t_ms") <= 800) & F.col("ball") & F.col("man")).alias("opening"), F.bool_or(F.col("direct") & ~F.col("ball")).alias("off_crop"),
        F.bool_or("fast").alias("fast"), F.bool_or("support_only").alias("support"))
    act = ~F.col("support")
    code = lambda c, name: F.when(c, F.lit(name))
    issues = F.array_compact(F.array(
        code(F.col("off_crop"), "observed_ball_outside_safe_crop"), code(F.col("fast"), "within_shot_camera_speed_exceeded"),
        code(act & ~F.col("opening"), "opening_carrier_and_ball_missing"),
        code(act & ((F.col("contact_n") == 0) | (F.col("contact_joint") < 0.5)), "contact_carrier_and_ball_unverified"),
        code(act & (F.col("setup_n") > 0) & (F.col("setup_joint") < 0.5), "setup_carrier_and_ball_unverified"),
        code(act & (F.col("flight_n") > 0) & (F.col("flight_ball") < 0.5), "ball_flight_unverified"),
        code(act & ((F.col("payoff_n") == 0) | (F.col("payoff_ball") < 0.4)), "resolved_action_ball_unverified"),
    ))
    return g.select(*SCENE, (~F.col("off_crop") & ~F.col("fast")).alias("usable"), F.array_join(issues, ",").alias("issues"),
                    *[r4(F.col(f"{p}_ball")).alias(f"{p}_ball") for p in in_phase], *[r4(F.col(f"{p}_joint")).alias(f"{p}_joint") for p in in_phase])


def decision_subject(people: DataFrame, frames: DataFrame, view: float) -> DataFrame:
    """Coverage of the dominant person of each shot around one fixed centre.

    Rows carry ``shot_no``. The dominant track has most rows, then the tallest first box.
    """
    per = people.where("track_id IS NOT NULL").groupBy(*SCENE, "shot_no", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.col("y2") - F.col("y1"), F.struct("t_ms", "idx")).alias("h"), F.min(F.struct("t_ms", "idx")).alias("first"),
        F.array_sort(F.collect_list((F.col("x1") + F.col("x2")) / 2)).alias("xs"))
    top = per.groupBy(*SCENE, "shot_no").agg(F.max(F.struct("n", "h", (-F.col("first.t_ms")).alias("t"), (-F.col("first.idx")).alias("i"), "track_id", "xs")).alias("d"))
    centre = F.greatest(F.lit(view / 2), F.least(F.lit(1 - view / 2), F.element_at("d.xs", (F.floor(F.size("d.xs") / 2) + 1).cast("int"))))
    subject = top.select(*SCENE, "shot_no", F.col("d.track_id").alias("subject"), centre.alias("centre"))
    seen = people.groupBy(*SCENE, "shot_no", "frame", "track_id").agg(F.min_by(F.struct("x1", "x2", "y1", "y2"), F.col("idx")).alias("b"))
    hit = frames.join(subject, [*SCENE, "shot_no"], "left").join(
        seen.withColumnRenamed("track_id", "subject"), [*SCENE, "shot_no", "frame", "subject"], "left")
    ok = (
        (F.col("b.x1") >= F.col("centre") - view / 2 + 0.005) & (F.col("b.x2") <= F.col("centre") + view / 2 - 0.005) & (F.col("b.y1") >= 0) & (F.col("b.y2") <= 1)
    )
    return hit.groupBy(*SCENE).agg(
        r4(F.when(F.bool_or(F.col("subject").isNull()), 0.0).otherwise(ratio(ok))).alias("coverage"),
        (~F.bool_or(F.col("subject").isNull()) & (ratio(ok) >= 0.8)).alias("verified"))


def phase_problems(keyframes: DataFrame, scenes: DataFrame) -> DataFrame:
    """Keyframe problems of an action scene as a code list.

    ``scenes`` carries origin offset, replay, goal and reaction flags; frames carry guidance and marker flags.
    """
    ph = F.col("phase")
    rows = keyframes.where(ph.isin("setup", "contact", "flight", "payoff")).join(scenes, SCENE).where(~F.col("player_only"))
    w = scene_window()
    direct = F.col("direct") & F.col("ball_in_frame") & S.not_false("player_in_frame") & F.col("joint_fit")
    guided = F.col("replay") & F.col("guided") & F.col("ball_in_frame") & S.not_false("player_in_frame") & F.col("joint_fit")
    lock = F.when(F.col("replay"), guided).otherwise(direct)
    origin = ph.isin("setup", "contact")
    rows = rows.withColumns(dict(lock=lock, direct_joint=direct, guided_joint=guided, n=F.row_number().over(w)))
    first_contact = F.min(F.when(ph == "contact", F.col("n"))).over(Window.partitionBy(*SCENE))
    contacts = F.count(F.when(ph == "contact", 1)).over(Window.partitionBy(*SCENE))
    at = F.coalesce(first_contact, F.lit(1))
    around = (F.col("n") >= at - 5) & (F.col("n") < at + F.greatest(F.lit(5), contacts + 4))
    rows = rows.withColumns(dict(around=around, is_origin=origin, late_origin=origin & (F.col("t_ms") >= F.greatest(F.lit(0), F.col("origin_ms") - 120))))
    whole = Window.partitionBy(*SCENE)
    n_o, n_l = F.count(F.when(F.col("is_origin"), 1)).over(whole), F.count(F.when(F.col("late_origin"), 1)).over(whole)
    rows = rows.withColumn("acq", F.when(n_l >= F.least(F.lit(3), n_o), F.col("late_origin")).otherwise(F.col("is_origin")))
    acq = rows.where("acq")
    five = Window.partitionBy(*SCENE).orderBy("t_ms").rowsBetween(0, 4)
    acq = acq.withColumns(dict(
        k=F.row_number().over(w), s5=F.sum(F.col("lock").cast("int")).over(five), c5=F.count(F.lit(1)).over(five), last5=F.max("t_ms").over(five)))
    opened = acq.groupBy(*SCENE).agg(F.bool_or(
        ((F.col("k") == 1) & (F.col("s5") / F.col("c5") >= 0.6))
        | ((F.col("c5") == 5) & (F.col("s5") >= 3) & (F.col("last5") <= F.col("origin_ms") + 1050))).alias("opened"))
    g = rows.groupBy(*SCENE).agg(
        F.bool_or(F.col("around") & origin & (F.col("direct_joint") | F.col("guided_joint"))).alias("pre"),
        F.bool_or(F.col("around") & ph.isin("contact", "flight") & F.col("direct") & F.col("ball_in_frame")).alias("post"),
        F.count(F.when(ph == "flight", 1)).alias("flights"), ratio(F.col("ball_in_frame") & (F.col("direct") | F.col("guided")), ph == "flight").alias("flight"),
        F.count(F.when(ph == "payoff", 1)).alias("payoffs"),
        ratio((F.col("direct") & F.col("ball_in_frame")) | F.col("payoff_in_frame") | (F.col("replay") & F.col("guided") & F.col("ball_in_frame")), ph == "payoff").alias("payoff"),
        F.bool_or(ph.isin("flight", "payoff") & F.col("marker")).alias("late_marker"), F.bool_or("goal").alias("goal"))
    out = g.join(opened, SCENE, "left")
    code = lambda c, name: F.when(F.coalesce(c, F.lit(True)), F.lit(name))
    return out.select(*SCENE, F.array_join(F.array_compact(F.array(
        code(~F.coalesce("opened", F.lit(False)), "opening_player_ball_not_locked"), code(~F.col("pre") | ~F.col("post"), "contact_keyframes_incomplete"),
        code((F.col("flights") > 0) & (F.col("flight") < 0.75), "ball_flight_keyframes_incomplete"),
        code((F.col("payoffs") == 0) | (F.col("payoff") < F.when(F.col("goal"), 0.5).otherwise(0.2)), "payoff_keyframes_incomplete"),
        code(F.col("late_marker"), "player_marker_continues_after_contact"))), ",").alias("problems"))


def scene_metrics(records: DataFrame, contact_ms: Column, goal: Column) -> DataFrame:
    """The wide metric row of a scene in one aggregation, joined with its window metrics."""
    ph = F.col("phase")
    sc, fl, pay = ph.isin("setup", "contact"), ph == "flight", ph == "payoff"
    act = ph.isin("setup", "contact", "flight")
    near = F.col("t_ms").between(contact_ms - 300, contact_ms + 250)
    shown = F.col("ball_in_frame") & F.col("direct")
    wide = records.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("frames"), r4(ratio(F.col("direct"))).alias("ball_cov"), r4(ratio(F.col("track_id").isNotNull())).alias("player_cov"),
        r4(ratio(F.col("joint_fit"))).alias("joint_fit_cov"), r4(ratio(F.col("subject_confidence") >= 0.48)).alias("lock_cov"),
        r4(ratio(F.col("possession"))).alias("possession_cov"), ratio(F.col("joint_fit") & F.col("direct"), sc).alias("_origin"),
        ratio(shown, fl).alias("_flight"), F.count(F.when(fl, 1)).alias("_fn"), ratio(F.col("payoff_in_frame"), pay).alias("_pay"),
        ratio(F.col("joint_fit") & F.col("direct"), near).alias("_contact"), r4(ratio(shown, act)).alias("action_ball"),
        r4(F.coalesce(F.percentile(F.when(F.col("spread") > 0, F.col("spread")), 0.9), F.lit(0.0))).alias("spread_p90"),
        F.round(F.coalesce(F.median(F.when(F.col("direct"), F.col("ball_px"))), F.lit(0.0)), 2).alias("ball_px_median"),
        F.bool_or(goal).alias("_goal"))
    complete = ~F.col("_goal") | ((F.round("_contact", 4) >= 0.35) & (F.col("_origin") >= 0.5) & ((F.col("_fn") == 0) | (F.col("_flight") >= 0.35)) & (F.col("_pay") >= 0.5))
    one = lambda c: r4(F.when(F.col("_goal"), F.col(c)).otherwise(1.0))
    flat = wide.select(*SCENE, "frames", "ball_cov", "player_cov", "joint_fit_cov", "lock_cov", "possession_cov", "action_ball", "spread_p90", "ball_px_median",
                       one("_origin").alias("goal_origin"), one("_flight").alias("goal_flight"), one("_pay").alias("goal_payoff"), complete.alias("action_complete"))
    return flat.join(longest_gap(records), SCENE).join(camera_metrics(records), SCENE)


# -- verdicts -----------------------------------------------------------------


def native_verdict(rows: DataFrame) -> DataFrame:
    """Full-frame verdict from phase ratios (``setup_*``, ``contact_*``, ``flight_*``, ``payoff_*``)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    setup = (z("setup_n") > 0) & (z("setup_ball") >= 0.75) & ((z("setup_direct") >= 0.30) | (z("player_cov") >= 0.65))
    direct = (z("contact_ball") >= 0.75) & (z("contact_direct") >= 0.40)
    handoff = (
        (z("setup_direct") >= 0.55) & (z("contact_ball") >= 0.25) & (z("contact_payoff") >= 0.40) & ((z("flight_ball") >= 0.35) | (z("flight_payoff") >= 0.55)))
    contact = (z("contact_n") > 0) & (direct | handoff)
    flight = (z("flight_n") > 0) & ((z("flight_ball") >= 0.40) | (z("flight_payoff") >= 0.50))
    payoff = (z("payoff_n") > 0) & ((z("payoff_payoff") >= 0.50) | (z("payoff_ball") >= 0.40))
    must = F.col("event_type").isin("goal", "shot_on_target", "shot_off_target", "save", "big_chance")
    blind = F.col("setup_n").isNull() | ~S.is_true("semantic_verified") | ~S.not_false("action_complete") | ~S.not_false("ball_visible") | ~S.not_false("player_visible")
    mode = (
        F.when(S.reaction(), "planned_reaction").when(blind, "native_action_evidence_missing").when(~setup, "native_setup_evidence_incomplete")
        .when(~contact, "native_contact_evidence_incomplete").when(~flight, "native_flight_evidence_incomplete")
        .when(must & ~payoff, "native_payoff_evidence_incomplete").when(F.col("event_type") == "goal", "native_frame_verified_goal").otherwise("native_frame_verified_action"))
    return rows.withColumn("mode", mode).withColumn("usable", F.col("mode").isin("planned_reaction", "native_frame_verified_goal", "native_frame_verified_action"))


def framing_verdict(rows: DataFrame) -> DataFrame:
    """Ordered verdict over one wide row per scene: metrics, phase ratios and keyframe problems."""
    z = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    t = S.is_true
    goal = F.col("event_type").isin(*S.SCORING)
    sem = t("semantic_verified") & t("action_complete")
    seen = t("ball_visible") & t("player_visible")
    conf = z("confidence")
    direct, player, jv, jf = z("ball_cov"), z("player_cov"), z("joint_vis"), z("joint_fit_cov")
    gap = z("gap_s", float("inf"))
    pay = z("goal_payoff")
    step, p95, jerk = z("max_step", float("inf")), z("step_p95", float("inf")), z("jerk_p95", float("inf"))
    rate, jumps, moves = z("reversal_rate"), F.coalesce("jumps", F.lit(0)), F.coalesce("moves", F.lit(0))
    cut = F.coalesce("declared_cut", F.lit(False))
    fit = (jf >= 0.70) | (goal & sem & (jf >= 0.55))
    isolated = (p95 <= F.when(cut, 0.055).otherwise(0.030)) & fit & ((step <= 0.25) | ((jumps <= 1) & (jerk <= 0.020) & (cut | (p95 <= 0.030))))
    pan = (moves >= 4) & (rate <= 0.10) & (step <= 0.30) & (p95 <= 0.065) & fit
    sem_pan = sem & (moves >= 4) & (rate <= 0.10) & (step <= 0.12) & (p95 <= 0.055) & (jerk <= 0.040) & (jf >= 0.45) & (direct >= 0.45) & (player >= 0.85)
    phased = F.col("setup_n").isNotNull()
    stable = pan | sem_pan | ((~phased | (step <= 0.055) | isolated) & ((p95 <= 0.030) | isolated) & ((jerk <= 0.020) | isolated))
    rows = rows.withColumn("_stable", stable)
    stable = F.col("_stable")
    least = lambda v, th, n: (z(v) >= th) | ((z(n) >= 4) & (z(v) + 1 / F.greatest(z(n), F.lit(1.0)) >= th))
    touch = goal & phased & sem & (z("setup_direct") >= 0.55) & (z("contact_ball") >= 0.25) & (z("contact_payoff") >= 0.40) & (z("payoff_payoff") >= 0.50) & (pay >= 0.50)
    rows = rows.withColumn("_touch", touch)
    touch = F.col("_touch")
    fly = (
        goal & phased & sem & ((z("contact_direct_ball") >= 0.50) | touch) & ((z("contact_ball") >= 0.70) | touch)
        & (z("flight_payoff") >= 0.55) & (z("payoff_payoff") >= 0.50) & (pay >= 0.50))
    rows = rows.withColumn("_fly", fly)
    fly = F.col("_fly")
    act = z("action_ball")
    flight_ok = (
        (z("flight_n") == 0) | least("flight_direct_ball", 0.45, "flight_n") | ((z("flight_ball") >= 0.60) & (act >= 0.80)) | fly
        | ((z("flight_n") <= 8) & (z("flight_direct_ball") >= 0.25) & (z("contact_direct_ball") >= 0.50) & (pay >= 0.50))
        | ((z("flight_n") <= 3) & (z("contact_ball") >= 0.50) & (z("payoff_payoff") >= 0.50)))
    sem_goal = (
        goal & phased & sem & seen & (conf >= 0.90) & least("setup_direct", 0.55, "setup_n") & (least("contact_direct", 0.35, "contact_n") | touch)
        & flight_ok & (z("payoff_n") > 0) & (pay >= 0.50) & (direct >= 0.45) & (player >= 0.85) & ((gap <= 3.0) | (fly & (gap <= 4.0))) & stable)
    rows = rows.withColumn("_sem_goal", sem_goal)
    sem_goal = F.col("_sem_goal")
    rep = S.replay()
    rep_goal = (
        rep & goal & phased & sem & (conf >= 0.90) & least("setup_ball", 0.85, "setup_n") & least("setup_joint", 0.60, "setup_n") & (z("setup_direct") >= 0.20)
        & least("contact_ball", 0.85, "contact_n") & least("contact_joint", 0.85, "contact_n") & (z("contact_direct") >= 0.25)
        & ((z("flight_n") == 0) | ((z("flight_ball") >= 0.90) & (z("flight_direct_ball") >= 0.10))) & (z("payoff_n") > 0) & (pay >= 0.50)
        & (act >= 0.90) & (direct >= 0.20) & (player >= 0.85) & (gap <= 3.0) & stable)
    rows = rows.withColumn("_rep_goal", rep_goal)
    rep_goal = F.col("_rep_goal")
    recovered = (
        goal & ~phased & t("action_complete") & seen & (conf >= 0.90) & (direct >= 0.65) & (player >= 0.85) & (jv >= 0.85)
        & ((jf >= 0.70) | (goal & sem & (jf >= 0.60))) & (gap <= 1.2) & (pay >= 0.50) & stable)
    rows = rows.withColumn("_recovered", recovered)
    recovered = F.col("_recovered")
    done = ~goal | S.not_false("ev_complete") | recovered | sem_goal | rep_goal
    rows = rows.withColumn("_done", done)
    done = F.col("_done")
    held = goal & t("ev_complete") & (act >= 0.90) & (pay >= 0.75)
    allow = F.when(goal, F.when(fly | held, 4.0).otherwise(3.0)).otherwise(2.4)
    rows = rows.withColumn("_allow", allow)
    allow = F.col("_allow")
    ready = ~goal | (pay >= 0.10)
    phase_act = F.col("event_type").isin("goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance", "assist", "free_kick")
    first_problem = F.when(phase_act & (F.coalesce("problems", F.lit("")) != ""), F.concat(F.lit("keyframe_"), F.element_at(F.split("problems", ","), 1)))
    other = (
        ~goal & sem & least("setup_direct", 0.50, "setup_n") & least("contact_direct", 0.35, "contact_n") & ((z("flight_n") == 0) | least("flight_direct_ball", 0.35, "flight_n"))
        & (z("payoff_n") > 0) & (F.greatest(z("payoff_ball"), z("payoff_joint"), z("payoff_payoff")) >= 0.20) & (direct >= 0.45) & (player >= 0.80) & (gap <= allow) & stable)
    rows = rows.withColumn("_other", other)
    other = F.col("_other")
    plain = (
        (z("setup_n") > 0) & F.when(rep, least("setup_joint", 0.50, "setup_n")).otherwise(least("setup_joint", 0.72, "setup_n"))
        & F.when(rep, least("setup_direct", 0.45, "setup_n")).otherwise(least("setup_direct", 0.50, "setup_n")) & (z("contact_n") > 0) & (z("contact_direct") >= 0.35)
        & ((z("flight_n") == 0) | ((z("flight_direct_ball") >= 0.35) & (z("flight_ball") >= 0.75))) & (z("payoff_n") > 0)
        & F.when(goal, pay >= 0.50).otherwise(F.greatest(z("payoff_direct_ball"), z("payoff_payoff")) >= 0.50))
    rows = rows.withColumn("_plain", plain)
    plain = F.col("_plain")
    complete = sem_goal | rep_goal | other | plain
    opened = (direct >= 0.55) & (jv >= 0.85) & (jf >= 0.78) & (gap <= 1.2)
    strict = (t("opening") | opened) & (direct >= 0.35) & (jv >= 0.72) & (jf >= 0.68) & (gap <= allow) & stable & ready & done
    rows = rows.withColumn("_strict", strict)
    strict = F.col("_strict")
    ai = seen & (conf >= 0.84) & (z("visual_clarity") >= 80)
    local = (player >= 0.80) & (direct >= 0.30) & (jv >= 0.70) & (jf >= 0.65) & (gap <= allow) & stable
    close = rep & ai & (player >= 0.85) & (jf >= 0.62) & (gap <= allow) & stable & (z("visual_clarity") >= 88) & ready & done
    repaired = (
        t("full_bleed_repair") & (F.coalesce("metrics_version", F.lit(0)) >= 2) & t("final_crop_verified") & sem & seen & (conf >= 0.85)
        & (~goal | (t("ev_complete") & (act >= 0.90) & (pay >= 0.50))))
    in_phase = phased & phase_act
    player_only = ~F.col("event_type").isin(
        "goal", "disallowed_goal", "offside", "var", "save", "shot_on_target", "shot_off_target", "big_chance", "assist", "free_kick", "penalty"
    ) & (S.reaction() | F.coalesce(F.col("camera_mode") == "reaction", F.lit(False)))
    mode = (
        F.when(player_only, "planned_reaction").when(F.col("frames").isNull(), "missing_tracking").when(repaired, "full_bleed_repaired")
        .when(first_problem.isNotNull(), first_problem)
        .when(in_phase & (~complete | ~done), F.when(goal, "incomplete_goal_action").otherwise("incomplete_action_phases"))
        .when(in_phase & ~stable, "unstable_camera").when(in_phase & (gap > allow), "ball_not_visibly_continuous")
        .when(in_phase, F.when(goal, "phase_verified_goal").otherwise("phase_verified_action"))
        .when(strict, "strict").when(ai & local & ready & done, "ai_confirmed_joint_scene").when(close, "ai_confirmed_close_replay")
        .when(goal & ~done, "incomplete_goal_action").when(goal & ~ready, "missing_goal_payoff")
        .when((direct < 0.30) | (gap > allow), "ball_not_visibly_continuous").when(~stable, "unstable_camera").otherwise("insufficient_joint_framing"))
    good = ["planned_reaction", "full_bleed_repaired", "phase_verified_goal", "phase_verified_action", "strict", "ai_confirmed_joint_scene", "ai_confirmed_close_replay"]
    extra = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("mode", mode).withColumn("usable", F.col("mode").isin(*good)).drop(*extra)


def goal_side_conflict(path: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes whose ball runs away from the verified goal side.

    Medians over the touch window and over the last five flight samples of a scene.
    """
    rows = path.join(scenes, SCENE).where("ball_x IS NOT NULL")
    near = F.col("t_ms").between(F.col("contact_ms") - 320, F.col("contact_ms") + 240)
    fly = F.col("t_ms").between(F.col("contact_ms") + 280, F.col("payoff_ms") + 120)
    late = Window.partitionBy(*SCENE, fly).orderBy(F.desc("t_ms"))
    tagged = rows.withColumns(dict(near=near, fly=fly, back=F.row_number().over(late)))
    g = tagged.groupBy(*SCENE).agg(
        F.count(F.when(F.col("near"), 1)).alias("a"), F.count(F.when(F.col("fly"), 1)).alias("b"), F.median(F.when(F.col("near"), F.col("ball_x"))).alias("cx"),
        F.median(F.when(F.col("fly") & (F.col("back") <= 5), F.col("ball_x"))).alias("fx"), F.max("goal_x").alias("gx"))
    moved, want = F.col("fx") - F.col("cx"), F.col("gx") - F.col("cx")
    bad = (F.col("a") >= 2) & (F.col("b") >= 2) & (F.abs(moved) >= 0.055) & (moved * want < 0)
    return g.select(*SCENE, F.coalesce(bad, F.lit(False)).alias("conflict"))


def scorer_track(players: DataFrame, records: DataFrame, scenes: DataFrame) -> DataFrame:
    """Track making the decisive touch: best player at the ball, else the best locked subject."""
    from matchspark.operators.linking import touch_distance_expr

    r = records.join(scenes, SCENE).where("direct")
    cand = players.where("role <> 'referee' AND track_id IS NOT NULL AND pitch_support >= 0.08 AND confidence >= 0.35").select(
        *SCENE, "frame", "cx", "x1", "x2", "y1", "y2", "track_age", F.col("track_id").alias("cand_id"))
    pair = r.where(F.col("t_ms").between(F.col("contact_ms") - 450, F.col("contact_ms") + 160)).select(
        *SCENE, "frame", "t_ms", "contact_ms", F.col("ball_x").alias("bx"), F.col("ball_y").alias("by")).join(cand, [*SCENE, "frame"])
    dist = touch_distance_expr(0.52)
    late = F.abs(F.col("t_ms") - F.col("contact_ms")) / 1000
    score = dist * 4.5 + late * 0.72 + F.when(F.col("t_ms") > F.col("contact_ms") + 40, 0.025).otherwise(0.0) - F.least(F.lit(12), F.col("track_age")) * 0.002
    best = pair.withColumns(dict(d=dist, s=score, late=late)).where("d <= 0.11").groupBy(*SCENE).agg(F.min(F.struct("s", "late", "d", "cand_id")).alias("m")).select(*SCENE, F.col("m.cand_id").alias("by_touch"))
    el = r.where(
        F.col("t_ms").between(F.col("contact_ms") - 450, F.col("contact_ms") + 120) & F.col("joint_fit") & F.col("track_id").isNotNull() & (F.col("subject_confidence") >= 0.48))
    order = F.struct(
        F.when(F.col("possession"), 0).otherwise(1).alias("o"), F.abs(F.col("t_ms") - F.col("contact_ms")).alias("a"),
        (F.col("t_ms") > F.col("contact_ms")).alias("b"), (-F.col("subject_confidence")).alias("c"), "track_id")
    back = el.groupBy(*SCENE).agg(F.min(order).alias("m")).select(*SCENE, F.col("m.track_id").alias("by_lock"))
    return scenes.select(*SCENE).join(best, SCENE, "left").join(back, SCENE, "left").select(*SCENE, F.coalesce("by_touch", "by_lock").alias("scorer_id"))


def stable_track(records: DataFrame, from_ms: int, to_ms: int, coverage: float = 0.70, n_min: int = 5) -> DataFrame:
    """The one continuously locked subject of a time window, if identity is stable."""
    win = records.where(F.col("t_ms").between(from_ms, to_ms))
    size = win.groupBy(*SCENE).agg(F.count(F.lit(1)).alias("n"))
    ok = win.where("direct AND joint_fit AND track_id IS NOT NULL AND subject_confidence >= 0.58")
    per = ok.groupBy(*SCENE, "track_id").agg(F.count(F.lit(1)).alias("hits"), F.avg("subject_confidence").alias("mean"))
    top = per.groupBy(*SCENE).agg(F.sum("hits").alias("all"), F.max(F.struct("hits", "mean", "track_id")).alias("t"))
    good = (F.col("n") >= n_min) & (F.col("all") >= n_min) & (F.col("t.hits") / F.col("n") >= coverage) & (F.col("t.mean") >= 0.65)
    return size.join(top, SCENE).where(good).select(*SCENE, F.col("t.track_id").alias("track_id"))


def outcome_subject(people: DataFrame, balls: DataFrame, boxes: DataFrame) -> DataFrame:
    """Goal-side person linked to the ball in each frame: lowest score wins."""
    p = people.join(balls, [*SCENE, "frame"]).join(boxes, SCENE)
    gx = F.coalesce("goal_focus_x", (F.col("g1") + F.col("g3")) / 2)
    gy = (F.col("g2") + F.col("g4")) / 2
    c = F.col
    foot = F.sqrt(F.pow(c("cx") - c("bx"), 2) + F.pow((c("y2") - c("by")) * 0.52, 2))
    ok = (
        (c("pitch_support") >= 0.04) & (c("y2") - c("y1") >= 0.032) & (F.abs(c("cx") - gx) <= F.greatest(F.lit(0.18), (c("g3") - c("g1")) * 0.75))
        & c("cx").between(c("g1") - 0.16, c("g3") + 0.16) & c("cy").between(c("g2") - 0.18, F.least(F.lit(1.0), c("g4") + 0.16)) & (foot <= 0.14))
    score = (
        F.abs(c("cx") - gx) * 1.55 + F.abs(c("cy") - gy) * 0.24 + F.sqrt(F.pow(c("cx") - c("bx"), 2) + F.pow((c("cy") - c("by")) * 0.45, 2)) * 0.22
        - F.least(F.lit(0.05), F.greatest(F.lit(0), c("track_age") - 1) * 0.006) - c("confidence") * 0.03)
    return p.where(ok).groupBy(*SCENE, "frame").agg(F.min_by("idx", F.struct(F.round(score, 9), "idx")).alias("idx"))


def section_summary(moments: DataFrame, plan: DataFrame) -> DataFrame:
    from matchspark.operators.linking import section_of

    local = section_of(moments, plan).join(moments.select("match_id", "moment_id", S.length_ms().alias("len")), ["match_id", "moment_id"])
    agg = local.groupBy("match_id", "section").agg(F.count(F.lit(1)).alias("scenes"), F.sum("len").alias("selected_ms"))
    return plan.join(agg, ["match_id", "section"], "left").select(
        "match_id", "section", "requested_ms", F.coalesce("scenes", F.lit(0)).alias("scenes"), F.coalesce("selected_ms", F.lit(0)).alias("selected_ms"))


def sync_problems(beats: DataFrame, block: Column) -> DataFrame:
    """Narration entries out of order or without a start, without speech, overrunning or repeated; without a beat id the moment names the entry."""
    named = beats.withColumn("identity", F.coalesce(F.nullif("beat_id", F.lit("")), F.col("moment_id")))
    rows = scan(named, ["match_id"], ["ordinal"], block, prior={"_prev": ("last", F.col("visual_ms"))})
    told = F.coalesce("narration", F.lit("")) != ""
    first = rows.where(told).groupBy("match_id", "identity").agg(F.min("ordinal").alias("_first"))
    rows = rows.join(first, ["match_id", "identity"], "left")
    speech = F.coalesce("speech_ms", F.lit(0))
    codes = F.array_compact(F.array(
        F.when(F.col("visual_ms").isNull() | F.coalesce(F.col("visual_ms") + 1 < F.col("_prev"), F.lit(False)), "non_monotonic_visual"), F.when(told & (speech <= 0), "missing_speech"),
        F.when(told & (speech > 0) & ((F.coalesce("length_ms", F.lit(0)) <= 0) | (F.col("length_ms") + 30 < speech)), "speech_exceeds_visual"),
        F.when(told & (F.col("ordinal") > F.col("_first")), "duplicate_narrated_beat")))
    return rows.select("match_id", "ordinal", F.col("identity").alias("beat_id"), F.explode(codes).alias("problem"))


def order_problems(beats: DataFrame, manifest: DataFrame, block: Column) -> DataFrame:
    """Beats whose scene does not come after the previous beat's scene."""
    rows = beats.join(manifest.select("match_id", F.col("moment_id").alias("evidence_id"), "position"), ["match_id", "evidence_id"])
    seen = scan(rows, ["match_id"], ["ordinal"], block, prior={"_prev": ("last", F.col("position"))})
    return seen.where(F.col("position") <= F.col("_prev")).select("match_id", "beat_id")


def story_deficiencies(moments: DataFrame) -> DataFrame:
    """Live goals without a replay or a celebration of their own story."""
    ok = moments.where(S.kept())
    have = ok.groupBy("match_id", "story_id").agg(
        F.count(F.when(S.replay(), 1)).alias("replays"), F.count(F.when(S.reaction(), 1)).alias("cheers"))
    goals = ok.where((F.col("event_type") == "goal") & ~S.replay()).join(have, ["match_id", "story_id"])
    own = F.when(S.reaction(), 1).otherwise(0)
    codes = F.array_compact(F.array(
        F.when(F.col("replays") == 0, "missing_same_goal_replay"), F.when(F.col("cheers") - own == 0, "missing_immediate_goal_celebration")))
    return goals.select("match_id", "moment_id", F.explode(codes).alias("problem"))


def sequence_problems(moments: DataFrame, block: Column) -> DataFrame:
    """Edited goals not followed by their own proof and reaction within three scenes."""
    rows = moments.where(S.not_false("selected")).withColumn("key", F.coalesce("edit_order", F.lit(1 << 30)))
    num = scan(rows, ["match_id"], ["key", "ordinal"], block, upto={"n": ("count", F.lit(1))})
    nxt = num.select("match_id", "n", "story_id", S.replay().alias("f_replay"), S.reaction().alias("f_react"))
    goals = num.where((F.col("event_type") == "goal") & ~S.replay()).select("match_id", "moment_id", "story_id", "n")
    after = goals.select("match_id", "moment_id", "story_id", F.col("n").alias("at"), F.explode(F.array(F.col("n") + 1, F.col("n") + 2, F.col("n") + 3)).alias("n"))
    hit = after.join(nxt.withColumnRenamed("story_id", "f_story"), ["match_id", "n"])
    same = F.col("f_story") == F.col("story_id")
    got = hit.groupBy("match_id", "moment_id").agg(
        F.bool_or(same & (F.col("n") == F.col("at") + 1) & (F.col("f_replay") | F.col("f_react"))).alias("proof"), F.bool_or(same & F.col("f_react")).alias("cheer"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    codes = F.array_compact(F.array(F.when(no("proof"), "goal_cut_to_unrelated_scene"), F.when(no("cheer"), "goal_missing_celebration")))
    return goals.join(got, ["match_id", "moment_id"], "left").select("match_id", "moment_id", F.explode(codes).alias("problem"))


def workflow_progress(jobs: DataFrame, moments: DataFrame, states: DataFrame) -> DataFrame:
    """Scene counts, verified counts and the phase of each job; waiting for a retry or for capacity."""
    locked = moments.where(S.is_true("selection_locked")).join(states, ["match_id", "moment_id"], "left")
    ok = S.is_true("tracking_passed") | F.coalesce(F.col("saved_status") == "verified", F.lit(False))
    per = locked.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("selected"), F.count(F.when(ok, 1)).alias("verified"),
        F.count(F.when(~ok & F.coalesce(F.col("saved_status") == "needs_repair", F.lit(False)), 1)).alias("needs_repair"),
        F.count(F.when(S.is_true("prepared"), 1)).alias("prepared"), F.sum(F.greatest(F.lit(0), S.length_ms())).alias("selected_ms"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    st = F.col("stage")
    phase = (
        F.when(st.isin("failed", "waiting_retry", "attention_required", "queued", "restoring", "downloading"), F.coalesce("workflow_phase", F.lit("split")))
        .when(st.isin("completed", "validating"), "review").when((st == "editing") & timed_narration() & F.col("narration_recorded").eqNullSafe(F.lit(False)), "effects")
        .when(st.isin("rendering", "editing"), "render").when(st == "generating_commentary", "voice")
        .when(st == "writing_content", "script").when(st.isin("aligning_content", "ranking"), "effects")
        .when((st == "tracking") & (z("selected") > 0) & (z("prepared") == z("selected")), "tracking").otherwise("split"))
    done = st == "completed"
    return jobs.join(per, "match_id", "left").select(
        "match_id", phase.alias("phase"), z("selected").alias("selected"), z("verified").alias("verified"), z("needs_repair").alias("needs_repair"),
        z("selected_ms").alias("selected_ms"), (done | ((z("selected") > 0) & (z("prepared") == z("selected")))).alias("split_done"),
        (done | ((z("selected") > 0) & (z("verified") == z("selected")))).alias("tracking_done"), ((st == "waiting_retry") | S.is_true("capacity_wait")).alias("waiting"))


def timed_narration() -> Column:
    """Jobs whose narration is recorded over the finished visual edit."""
    return F.coalesce(F.col("production_version") == 1, F.lit(False))


def scene_progress(jobs: DataFrame, moments: DataFrame, states: DataFrame) -> DataFrame:
    """Every locked scene: match_id, moment_id, place (by start), status, round and source_prepared.

    ``states`` has saved_status, saved_round and prepared; ``jobs`` the scene under work (active_id, active_status,
    active_round). A verified scene stays so; the one under work shows what happens to it, others what was saved.
    """
    locked = moments.where(S.is_true("selection_locked")).select("match_id", "moment_id", "ordinal", "start_ms", "tracking_passed")
    placed = scan(locked, ["match_id"], ["start_ms", "ordinal"], block_of(F.col("start_ms"), 1_000), upto={"place": ("count", F.lit(1))})
    both = placed.join(states, ["match_id", "moment_id"], "left").join(jobs.select("match_id", "stage", "active_id", "active_status", "active_round"), "match_id", "left")
    saved = F.coalesce("saved_status", F.lit("pending"))
    done = S.is_true("tracking_passed") | (saved == "verified")
    now = F.coalesce(F.col("active_id") == F.col("moment_id"), F.lit(False)) & ~done
    status = (
        F.when(done, "verified").when(now & (F.col("stage") == "failed"), "needs_repair").when(now & F.col("active_status").isin("repairing", "tracking"), F.col("active_status"))
        .when(saved == "needs_repair", "needs_repair").otherwise("pending"))
    turn = F.when(now, F.coalesce(F.when(F.col("active_round") != 0, F.col("active_round")), F.lit(1))).otherwise(F.coalesce("saved_round", F.lit(0)))
    return both.select("match_id", "moment_id", "place", status.alias("status"), turn.cast("long").alias("round"), S.is_true("prepared").alias("source_prepared"))


def section_progress(sections: DataFrame, moments: DataFrame) -> DataFrame:
    """Scenes whose middle lies in each section, and their length: the locked ones of a match, else its verified ones.

    ``sections`` has match_id, section, start_ms, end_ms, scene_count and selected_ms; a match with neither kind of scene keeps them.
    """
    sound = S.is_true("semantic_verified") & S.is_true("action_complete") & S.kept() & ~S.deferred()
    kind = F.when(S.is_true("selection_locked"), 0).when(sound, 1)
    able = moments.withColumn("kind", F.when(S.is_true("selection_locked") | sound, kind)).where("kind IS NOT NULL")
    also = able.where((F.col("kind") == 0) & sound).withColumn("kind", F.lit(1))  # a locked scene may be verified too
    scenes = able.unionByName(also)
    first = scenes.groupBy("match_id").agg(F.min("kind").alias("kind"))
    middle = scenes.join(first, ["match_id", "kind"], "left_semi").select("match_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("_m"), S.length_ms().alias("len"))
    inside = interval_join(middle.withColumn("_n", F.col("_m") + 1), sections.select("match_id", "section", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")), ["match_id"], ("_m", "_n"), ("_s", "_e"), 180_000)
    per = inside.groupBy("match_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("ms"))
    told = first.select("match_id", F.lit(True).alias("_told"))
    out = sections.join(told, "match_id", "left").join(per, ["match_id", "section"], "left")
    fresh = F.coalesce("_told", F.lit(False))
    return out.select("match_id", "section", F.when(fresh, F.coalesce("n", F.lit(0))).otherwise(F.col("scene_count")).alias("scene_count"), F.when(fresh, F.coalesce("ms", F.lit(0))).otherwise(F.col("selected_ms")).alias("selected_ms"))


# Steps of a job, in order.
STEPS = ["split", "tracking", "effects", "script", "voice", "render", "review"]


def step_status(progress: DataFrame, jobs: DataFrame) -> DataFrame:
    """match_id, step, number and status of each step, from ``workflow_progress`` and the job's own flags."""
    rows = progress.select("match_id", "phase", "split_done", "tracking_done", "waiting").join(jobs, "match_id")
    complete = F.col("stage") == "completed"
    ready = F.when(timed_narration(), S.is_true("visual_ready")).otherwise(S.is_true("visual_locked"))
    done = dict(
        split=F.col("split_done"), tracking=F.col("tracking_done"), effects=ready, script=S.is_true("script_approved"), voice=S.is_true("narration_recorded"), render=S.is_true("render_completed"), review=F.lit(False))
    halted = F.when(F.col("stage").isin("failed", "attention_required"), "paused").when(F.col("waiting"), "waiting").otherwise("active")

    def status(step: str) -> Column:
        skipped = F.lit(step == "voice") & F.col("voice").eqNullSafe(F.lit(False))
        return F.when(skipped, "skipped").when(complete | done[step], "complete").when(F.col("phase") == step, halted).otherwise("pending")

    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(i).alias("number"), status(s).alias("status")) for i, s in enumerate(STEPS, 1)])
    return rows.select("match_id", F.explode(steps).alias("s")).select("match_id", "s.step", "s.number", "s.status")


# -- reviews ------------------------------------------------------------------

# Fixed values.
CORE = ["passed", "correct_subject", "stable_camera", "ball_followed", "setup_visible", "contact_visible", "outcome_visible"]
# Physical outcome of a reviewed crop to event type.
CROP_EVENT = {"keeper_save": "save", "woodwork": "big_chance", "blocked": "big_chance", "wide": "shot_off_target", "over": "shot_off_target"}
# Fixed values.
GOAL_DOWNGRADE = {"woodwork": "big_chance", "blocked": "big_chance", "wide": "shot_off_target", "over": "shot_off_target"}
NON_GOAL_SHOTS = ["save", "shot_on_target", "shot_off_target", "big_chance"]


def reviewed_event_expr() -> Column:
    """Event type a complete crop review supports, or null."""
    clear = F.lit(True)
    for c in CORE:
        clear = clear & S.is_true(c)
    known = clear & (F.coalesce("issue_count", F.lit(0)) == 0) & F.col("outcome_ms").between(0, S.length_ms()) & (F.length(F.trim(F.coalesce("outcome_text", F.lit("")))) >= 12)
    scoring = F.col("event_type").isin(*S.SCORING)
    shot = F.col("event_type").isin(*NON_GOAL_SHOTS)
    as_goal = F.when((F.col("outcome_type") == "goal") & S.is_true("ball_entered"), F.col("event_type")).when(
        S.is_true("selection_locked"), S.lookup(GOAL_DOWNGRADE, F.col("outcome_type")))
    upgrade = (F.col("outcome_type") == "goal") & S.is_true("ball_entered") & S.is_true("goal_visible") & S.is_true("paired_goal") & (F.abs(F.col("outcome_ms") - F.col("paired_ms")) <= 500)
    as_shot = F.when(F.coalesce(upgrade, F.lit(False)), "goal").when(
        F.col("ball_entered").eqNullSafe(F.lit(False)), S.lookup(CROP_EVENT, F.col("outcome_type")))
    return F.when(F.coalesce(known, F.lit(False)), F.when(scoring, as_goal).when(shot, as_shot))


def reviewed_event(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reviewed_event", reviewed_event_expr())


def effective_checks(rows: DataFrame) -> DataFrame:
    """Required checks minus those the reviewed outcome makes moot (``required`` is an array)."""
    ev = reviewed_event_expr()
    no_keeper = ev.isNotNull() & F.col("outcome_type").isin("goal", "woodwork", "blocked", "wide", "over")
    no_rebound = (ev == "goal") & S.is_true("ball_entered") | ev.isin("shot_off_target", "big_chance")
    moot = F.array_compact(F.array(F.when(no_keeper, "keeperContactVisible"), F.when(no_rebound, "reboundFollowed")))
    return rows.withColumn("checks", F.array_join(F.array_sort(F.array_except("required", moot)), ","))


def review_verdict(rows: DataFrame) -> DataFrame:
    """Missing evidence of a rendered review; ``phase_seen`` lists phases with a valid check, ``gaps`` open phases."""
    support = S.reaction()
    flags = [("passed", F.lit(True)), ("correct_subject", F.lit(True)), ("stable_camera", F.lit(True)), ("outcome_visible", F.lit(True)),
             ("ball_followed", ~support), ("setup_visible", ~support), ("contact_visible", ~support), ("ball_entered", F.col("event_type") == "goal")]
    miss = [F.when(need & ~S.is_true(c), F.lit(c)) for c, need in flags]
    shot = F.col("event_type").isin("goal", *NON_GOAL_SHOTS)
    non = F.col("event_type").isin(*NON_GOAL_SHOTS)
    o = F.col("outcome_type")
    bad = shot & o.isNotNull() & ~F.coalesce(
        F.col("outcome_ms").between(0, S.length_ms()) & (F.length(F.trim(F.coalesce("outcome_text", F.lit("")))) >= 12)
        & o.isin("goal", "keeper_save", "woodwork", "blocked", "wide", "over"), F.lit(False))
    miss += [
        F.when(non & (S.is_true("ball_entered") | F.coalesce(o == "goal", F.lit(False))), "crop_outcome_contradicts_selected_non_goal"), F.when(bad, "unobserved_finishing_outcome"),
        F.when((F.col("event_type") == "goal") & o.isNotNull() & (o != "goal"), "crop_outcome_contradicts_selected_goal"),
        F.when(shot & (o == "keeper_save") & ~S.is_true("keeper_contact"), "keeper_touch_unobserved")]
    open_gaps = F.transform(F.array_except("gaps", "phase_seen"), lambda p: F.concat(F.lit("unobserved_"), p, F.lit("_gap")))
    codes = F.array_sort(F.concat(F.array_compact(F.array(*miss)), open_gaps))
    return rows.withColumn("missing", F.array_join(codes, ",")).withColumn(
        "usable", (F.size(codes) == 0) & (F.coalesce("observation_count", F.lit(0)) >= 2))


# Checks that a review may have been asked for.
REVIEW_CHECKS = [
    "receiverVisible", "keeperContactVisible", "keeperContextVisible", "reboundFollowed", "possessionOcclusionVerified", "trajectoryOcclusionVerified", "shotEntryOcclusionVerified",
]


def crop_gate(rows: DataFrame) -> DataFrame:
    """Whether a reviewed crop may be used, and its mode.

    Besides the columns of ``effective_checks``: ``versions_current`` (framing, clock and outcome versions), geometry_verified,
    semantic_verified, action_complete, subject_core, keeper_contact, goal_visible, ``required`` (null: not listed) and
    ``granted`` (checks the review answered with true). Celebrations, reactions and decisions need the subject's core in
    view; all others the ball followed from set-up to outcome. A goal that no reviewed outcome downgrades must be seen
    entering; a finish with an outcome needs one that the review supports; an observed save needs the keeper's contact.
    """
    checked = effective_checks(reviewed_event(rows))
    support = S.reaction() | F.col("event_type").isin(*S.DECISIONS)
    seen, event = F.col("reviewed_event"), F.col("event_type")
    all_true = lambda *cols: functools.reduce(lambda a, b: a & b, [S.is_true(c) for c in cols])
    goal = event.isin(*S.SCORING) & (seen.isNull() | (seen == event))
    left = F.filter(F.split("checks", ","), lambda x: x != "")
    met = F.forall(left, lambda x: x.isin(*REVIEW_CHECKS) & F.array_contains(F.coalesce("granted", F.array().cast("array<string>")), x))
    usable = (
        all_true("versions_current", "geometry_verified", "semantic_verified", "passed", "correct_subject", "stable_camera") & S.not_false("action_complete")
        & (~support | S.is_true("subject_core")) & (support | all_true("ball_followed", "setup_visible", "contact_visible", "outcome_visible"))
        & (~goal | all_true("goal_visible", "ball_entered")) & (~event.isin(*S.SHOTS) | F.col("outcome_type").isNull() | seen.isNotNull())
        & (~F.coalesce(seen == "save", F.lit(False)) | S.is_true("keeper_contact")) & F.col("required").isNotNull() & F.coalesce(met, F.lit(False)) & F.coalesce(F.col("issue_count") == 0, F.lit(False))
    )
    return checked.withColumn("usable", usable).withColumn("mode", F.when(F.col("usable"), "gemini_crop_verified").otherwise("gemini_crop_review_incomplete"))


def reviewed_brief(checks: DataFrame, scenes: DataFrame) -> DataFrame:
    """Phase clocks from a complete review: first setup, last contact before the payoff, first flight after it.

    ``checks`` carries phase, time, visibility and text; a review holds a few dozen.
    """
    ok = checks.where("ball_seen AND length(trim(text)) >= 12").join(scenes, ["match_id", "moment_id"]).where(F.col("c_ms").between(0, F.col("length_ms")))
    ph, t = F.col("phase"), F.col("c_ms")
    one = ok.groupBy("match_id", "moment_id").agg(
        F.min(F.when((ph == "setup") & F.col("player_seen"), t)).alias("setup"), F.min(F.when(ph == "payoff", t)).alias("payoff"))
    two = ok.join(one, ["match_id", "moment_id"]).groupBy("match_id", "moment_id", "setup", "payoff", "start_ms").agg(
        F.max(F.when((ph == "contact") & F.col("player_seen") & (t < F.col("payoff")), t)).alias("contact"))
    three = ok.select("match_id", "moment_id", "phase", "c_ms").join(two, ["match_id", "moment_id"]).groupBy("match_id", "moment_id", "setup", "payoff", "contact", "start_ms").agg(
        F.min(F.when((ph == "flight") & (t >= F.col("contact")) & (t < F.col("payoff")), t)).alias("flight"))
    full = three.where("setup IS NOT NULL AND contact IS NOT NULL AND flight IS NOT NULL AND payoff IS NOT NULL AND setup <= contact")
    s = F.col("start_ms")
    return full.select("match_id", "moment_id", (s + F.col("setup")).alias("origin_ms"), (s + F.col("contact")).alias("contact_ms"),
                       (s + F.col("flight")).alias("handoff_ms"), (s + F.col("payoff")).alias("payoff_ms"))


def merge_finish_review(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine an earlier review with a finish review: flags must hold in both, issues add up."""
    keep = ["correct_subject", "stable_camera", "ball_followed", "contact_visible"]
    rows = a.alias("a").join(b.alias("b"), ["match_id", "moment_id"])
    both = {c: S.is_true(F.col(f"a.{c}")) & S.is_true(F.col(f"b.{c}")) for c in keep}
    issues = F.array_sort(F.array_distinct(F.concat("a.issues", "b.issues")))
    passed = S.is_true(F.col("b.passed")) & S.is_true(F.col("a.setup_visible")) & (F.size(issues) == 0)
    for c in both.values():
        passed = passed & c
    return rows.select("match_id", "moment_id", *[v.alias(k) for k, v in both.items()], F.array_join(issues, ",").alias("issues"), passed.alias("passed"))


def outcome_policy(rows: DataFrame) -> DataFrame:
    """Disputed miss mechanisms: source and crop agree on no goal but not on how."""
    src = S.lookup({"save": "keeper_save", "shot_off_target": "miss", "shot_on_target": "on_target", "big_chance": "chance"}, F.col("source_type"))
    crop = S.lookup({"keeper_save": "keeper_save", "wide": "miss", "over": "miss", "woodwork": "woodwork", "blocked": "blocked"}, F.col("outcome_type"))
    hit = (
        F.col("source_scored").eqNullSafe(F.lit(False)) & S.is_true("passed") & F.col("ball_entered").eqNullSafe(F.lit(False))
        & ~F.col("event_type").isin(*S.SCORING) & src.isNotNull() & crop.isNotNull() & (src != crop))
    return rows.withColumn("disputed", F.coalesce(hit, F.lit(False)))


def outcome_conflicts(rows: DataFrame) -> DataFrame:
    """Physical outcome against the score context and against the source review."""
    scored, ev, dec = F.col("goal_scored"), F.col("o_event"), F.coalesce("goal_decision", F.lit(""))
    still = (F.col("score_status") == "unchanged") & S.is_true("goal_scored") & (ev == "goal") & (dec != "disallowed")
    raised = (
        (F.col("score_status") == "provisional") & (F.col("same_anchor") | F.col("event_type").isin(*S.SCORING))
        & (~S.is_true("goal_scored") | (ev != "goal") | (dec == "disallowed")))
    score = F.coalesce(F.when(F.col("score_status") == "unchanged", still).otherwise(raised), F.lit(False))
    review = S.is_true("semantic_verified") & S.is_true("proof_verified") & F.col("event_type").isin(*S.SCORING) & (
        scored.eqNullSafe(F.lit(False)) | F.coalesce(ev == "uncertain", F.lit(False)))
    return rows.withColumn("score_conflict", score).withColumn("conflict", score | review)


def reusable_outcomes(rows: DataFrame) -> DataFrame:
    """Earlier outcome observations that are complete, consistent and of the same source interval."""
    inside = lambda c: F.col(c).between(F.col("start_ms"), F.col("end_ms"))
    scoring = F.col("event_type").isin(*S.SCORING)
    want = F.when(F.col("event_type") == "disallowed_goal", "goal").otherwise(F.col("event_type"))
    full = (F.col("doubts") == 0) & (F.col("fact_count") > 0) & (
        (S.is_true("goal_scored") & (F.col("o_event") == "goal")) | (F.col("goal_scored").eqNullSafe(F.lit(False)) & F.col("o_event").isin(*NON_GOAL_SHOTS)))
    ok = (
        F.col("saved_signature").eqNullSafe(F.col("signature")) & (F.col("saved_start_ms") == F.col("start_ms")) & (F.col("saved_end_ms") == F.col("end_ms"))
        & S.is_true("semantic_verified") & S.is_true("action_complete") & S.is_true("proof_verified") & full & (F.col("o_event") == want) & (F.col("goal_scored") == scoring)
        & F.when(F.col("goal_scored"), F.col("goal_decision").isin("allowed", "disallowed", "unclear")).otherwise(F.col("goal_decision") == "not_applicable")
        & inside("origin_ms") & inside("contact_ms") & inside("payoff_start_ms") & inside("payoff_end_ms") & (F.col("contact_ms") >= F.col("origin_ms"))
        & (F.col("payoff_start_ms") >= F.col("contact_ms") - 125) & (F.col("payoff_end_ms") > F.col("contact_ms") + 50))
    # a generator instead of a filter: a pushed-down filter would repeat the inputs of every clock test
    cols = F.struct("match_id", "moment_id", "o_event", "goal_decision")
    return rows.select(F.inline(F.when(F.coalesce(ok, F.lit(False)), F.array(cols))))


def outcome_correction(rows: DataFrame) -> DataFrame:
    """Goal labels an authoritative guide of the same source proves wrong (needs ``guide``)."""
    to = S.lookup({"save": "save", "wide": "shot_off_target", "over": "shot_off_target", "blocked": "big_chance", "woodwork": "big_chance"}, F.col("guide_outcome"))
    touch = F.array_min(F.transform(F.filter("guide", lambda a: (a["phase"] == "contact") & a["ball"] & a["player"]), lambda a: a["t"]))
    result = F.exists("guide", lambda a: (a["phase"] == "payoff") & a["ball"] & (a["t"] > touch))
    ok = F.col("event_type").isin(*S.SCORING) & S.is_true("authoritative") & (F.col("doubts") == 0) & to.isNotNull() & F.col("same_source") & touch.isNotNull() & result
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn("corrected_type", to)


def outcome_recheck(reviews: DataFrame, obs: DataFrame) -> DataFrame:
    """Keeper saves without a keeper-ball contact within .5 s, or misses with an observed keeper touch."""
    c = F.col
    touch = (
        (c("bx1") <= c("kx2") + 0.02) & (c("bx2") >= c("kx1") - 0.02) & (c("by1") <= c("ky2") + 0.02) & (c("by2") >= c("ky1") - 0.02))
    pair = reviews.join(obs, ["match_id", "scene_id"], "left")
    near = F.abs(c("t_ms") - c("outcome_ms")) <= 500
    g = pair.groupBy("match_id", "scene_id", "outcome_type").agg(
        F.coalesce(F.bool_or(near & touch), F.lit(False)).alias("contact"), F.coalesce(F.bool_or(c("keeper_touch")), F.lit(False)).alias("touched"))
    again = ((c("outcome_type") == "keeper_save") & ~c("contact")) | (c("outcome_type").isin("woodwork", "blocked", "wide", "over") & c("touched"))
    return g.where(again).select("match_id", "scene_id", "outcome_type")


def plan_gate(obs: DataFrame, subject_only: Column) -> DataFrame:
    """Whether a scene's observations support a camera path, and which checks its review must pass."""
    gap = longest_gap(obs.withColumn("direct", F.col("ball_seen")))
    seen = lambda phase, extra: F.bool_or((F.col("phase") == phase) & extra)
    situ = F.col("situation")
    g = obs.groupBy(*SCENE).agg(
        F.bool_or(((F.col("phase") == "setup") | situ.isin("possession", "receive")) & F.col("ball_seen") & F.col("player_seen")).alias("setup"),
        F.bool_or(((F.col("phase") == "contact") | (situ == "release")) & F.col("ball_seen") & F.col("player_seen")).alias("contact"),
        F.bool_or(((F.col("phase") == "payoff") | (situ == "result")) & F.col("ball_seen")).alias("payoff"), ratio(F.col("ball_seen")).alias("cover"),
        F.bool_or(subject_only).alias("subject"), F.bool_or(situ == "receive").alias("rc"), F.bool_or(situ == "keeper_touch").alias("kt"), F.bool_or(situ == "rebound").alias("rb"))
    checks = F.array_compact(F.array(
        F.when(~F.col("subject") & F.col("kt"), "keeperContactVisible"), F.when(~F.col("subject") & F.col("rb"), "reboundFollowed"), F.when(~F.col("subject") & F.col("rc"), "receiverVisible")))
    ok = F.col("subject") | (F.col("setup") & F.col("contact") & F.col("payoff") & (F.col("gap_ms") <= 400) & (F.col("cover") >= 0.9))
    return g.join(gap, SCENE).select(*SCENE, ok.alias("usable"), F.array_join(F.array_sort(checks), ",").alias("checks"))
