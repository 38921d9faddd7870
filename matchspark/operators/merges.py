"""Merging newer observations into saved rows, with violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import scalar as S

WINDOW_FLAGS = ["setup_visible", "contact_visible", "payoff_visible", "clean_bounds"]


def merge_reviews(moments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Overlay present review fields; reject, reopen and keep newer local rejections."""
    t = S.is_true
    rows = moments.join(reviews.drop("ordinal"), ["match_id", "moment_id"], "left")
    flags = F.lit(True)
    for c in WINDOW_FLAGS:
        flags = flags & t(c)
    move = (
        ~t("selection_locked") & t("r_verified") & flags & (F.col("w_start_ms") >= F.col("w_review_start_ms")) & (F.col("w_end_ms") <= F.col("w_review_end_ms") + 1)
        & (F.col("w_end_ms") > F.col("w_start_ms")))
    move = F.coalesce(move, F.lit(False))
    event = F.coalesce("r_event_type", "event_type")
    rep = F.coalesce("r_is_replay", "is_replay")
    phase = F.coalesce("r_phase", "story_phase")
    phase = F.when(~event.isin("celebration", "var") & (phase == "reaction"), F.when(rep, "replay").otherwise("action")).otherwise(phase)
    denied = F.col("r_verified").eqNullSafe(F.lit(False))
    was = (F.col("tracking_decision") == "semantic_mismatch") | (F.col("tracking_decision").isNull() & F.col("semantic_verified").eqNullSafe(F.lit(False)))
    reopened = t("r_verified") & F.coalesce(was, F.lit(False)) & ~t("selection_locked") & (F.coalesce("r_version", F.lit(0)) >= F.coalesce("version", F.lit(0)))
    return rows.select(
        "match_id", "moment_id", event.alias("event_type"), rep.alias("is_replay"), phase.alias("story_phase"),
        F.coalesce("r_verified", "semantic_verified").alias("semantic_verified"), F.coalesce("r_complete", "action_complete").alias("action_complete"),
        F.when(move, F.col("w_start_ms")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(move, F.col("w_end_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(denied, "reject").when(reopened, F.when(rep, "replay").otherwise("keep")).otherwise(F.col("keep_decision")).alias("keep_decision"),
        F.when(denied, "semantic_mismatch").when(reopened, None).otherwise(F.col("tracking_decision")).alias("tracking_decision"),
        F.when(denied, F.col("r_reject_reason")).when(reopened, None).otherwise(F.col("reject_reason")).alias("reject_reason"))


def apply_review_window(moments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Bounds from a fully proven review window (relative to ``source_start_ms``), with its state."""
    t = S.is_true
    rows = moments.join(reviews.drop("ordinal"), ["match_id", "moment_id"])
    skip = t("selection_locked") | ~t("r_verified") | ~t("r_complete") | F.col("r_event_type").isin("celebration", "var", "offside")
    flags = F.lit(True)
    for c in WINDOW_FLAGS:
        flags = flags & t(c)
    s, e = F.col("w_start_ms") - F.col("source_start_ms"), F.col("w_end_ms") - F.col("source_start_ms")
    c, p0, p1 = F.col("rel_contact_ms"), F.col("rel_payoff_start_ms"), F.col("rel_payoff_end_ms")
    ok = flags & (s >= 0) & (F.col("w_end_ms") <= F.col("source_end_ms") + 1) & (e > s + 100) & (c >= s) & (p0 >= c) & (p0 < e) & (p1 > p0) & (p1 <= e + 1)
    state = F.when(skip, "unchanged").when(F.coalesce(ok, F.lit(False)), "replaced").otherwise("unproven")
    rows = rows.withColumn("state", state)
    hit = F.col("state") == "replaced"
    return rows.select("match_id", "moment_id", "state", F.when(hit, F.col("w_start_ms")).when(F.col("state") == "unchanged", F.col("start_ms")).alias("start_ms"),
                       F.when(hit, F.col("w_end_ms")).when(F.col("state") == "unchanged", F.col("end_ms")).alias("end_ms"), (~skip & ~flags).alias("conflicting"))


def reject_non_play(moments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Synthetic reactions reviewed as play, and normal play without ball evidence."""
    rows = moments.join(reviews.drop("ordinal"), ["match_id", "moment_id"])
    mismatch = (F.col("completion_reason") == "candidate reaction window immediately following a verified live goal") & ~F.col("r_event_type").isin("celebration", "var", "offside")
    idle = (F.col("r_event_type") == "normal_play") & ~F.exists("required", lambda r: F.array_contains(r["subjects"], "ball"))
    why = F.when(F.coalesce(mismatch, F.lit(False)), "synthetic_reaction_mismatch").when(F.coalesce(idle, F.lit(False)), "normal_play_without_ball")
    return rows.select("match_id", "moment_id", why.alias("reason")).where("reason IS NOT NULL")


def merge_replacements(moments: DataFrame, new: DataFrame) -> DataFrame:
    """Replace locked scenes by id; a changed story or a vanished goal is a violation row."""
    rows = moments.join(new.select("match_id", "moment_id", F.col("story_id").alias("n_story"), F.col("event_type").alias("n_event"), F.col("start_ms").alias("n_start"), F.col("end_ms").alias("n_end"), F.lit(True).alias("_n")),
                        ["match_id", "moment_id"], "left")
    has = F.col("_n").isNotNull()
    bad = (
        F.when(has & (~S.is_true("selection_locked") | (F.col("n_story") != F.col("story_id"))), "identity_changed")
        .when(has & (F.col("event_type") == "goal") & (F.col("n_event") != "goal"), "goal_dropped"))
    use = has & bad.isNull()
    return rows.select("match_id", "moment_id", bad.alias("violation"), F.when(use, F.col("n_event")).otherwise(F.col("event_type")).alias("event_type"),
                       F.when(use, F.col("n_start")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(use, F.col("n_end")).otherwise(F.col("end_ms")).alias("end_ms"))


def merge_missing(saved: DataFrame, correction: DataFrame) -> DataFrame:
    """Replace or append requested reviews that came back exactly once and complete."""
    one = correction.groupBy("match_id", "moment_id").agg(F.count(F.lit(1)).alias("n"), F.first("verdict").alias("verdict"), F.first("complete").alias("complete"))
    good = one.where("n = 1 AND verdict IS NOT NULL AND complete IS NOT NULL").drop("n")
    return saved.join(good, ["match_id", "moment_id"], "left_anti").select("match_id", "moment_id", "verdict", "complete").unionByName(good)


def blocked_scenes(moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Locked scenes without verified evidence for exactly their interval."""
    ok = evidence.where("crop_verified AND geometry_verified").select("match_id", "moment_id", F.col("ev_start_ms").alias("start_ms"), F.col("ev_end_ms").alias("end_ms"))
    return moments.where(S.is_true("selection_locked")).join(ok, ["match_id", "moment_id", "start_ms", "end_ms"], "left_anti")


def restore_beat_order(moments: DataFrame, beats: DataFrame) -> DataFrame:
    """Give each selected scene its beat by text, else by id; a beat is used once, in edit order."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    sel = moments.where("selected").withColumn("key", norm(F.col("commentary")))
    text = beats.withColumn("key", norm(F.col("narration"))).where("key <> ''").groupBy("match_id", "key").agg(F.max_by("beat_id", "ordinal").alias("t_beat"))
    ident = beats.select("match_id", "beat_id", F.col("beat_id").alias("i_beat")).distinct()
    rows = sel.join(text, ["match_id", "key"], "left").join(ident, ["match_id", "beat_id"], "left")
    rows = rows.withColumn("got", F.when(F.col("key") != "", F.coalesce("t_beat", "i_beat")))
    first = rows.where("got IS NOT NULL").groupBy("match_id", "got").agg(F.min_by("moment_id", F.struct(F.coalesce("edit_order", F.lit(1 << 30)), "ordinal")).alias("moment_id"))
    return rows.select("match_id", "moment_id").join(first, ["match_id", "moment_id"], "left").withColumnRenamed("got", "beat_id")


def apply_replacement(moments: DataFrame) -> DataFrame:
    """Reselected interval of a blocked scene, or the reason it cannot be used.

    ``guide`` holds at most six anchors; ``pick_start_ms``/``pick_end_ms`` the chosen interval.
    """
    inside = F.filter("guide", lambda a: (a["t"] >= F.col("pick_start_ms")) & (a["t"] <= F.col("pick_end_ms")))
    rows = moments.withColumn("g", inside)
    touches = F.transform(F.filter("g", lambda a: (a["phase"] == "contact") & a["ball"] & a["player"]), lambda a: a["t"])
    payoff = F.array_min(F.transform(F.filter("g", lambda a: (a["phase"] == "payoff") & a["ball"] & (a["t"] > F.array_min(touches))), lambda a: a["t"]))
    rows = rows.withColumns(dict(touches=touches, payoff=payoff))
    contact = F.array_max(F.filter("touches", lambda t: t < F.col("payoff")))
    rows = rows.withColumn("contact", contact)
    setup = F.exists("g", lambda a: a["phase"].isin("setup", "contact", "flight") & a["ball"] & a["player"] & (a["t"] < F.col("contact")))
    end = F.least("pick_end_ms", F.col("payoff") + 500)
    why = (
        F.when((F.col("pick_end_ms") - F.col("pick_start_ms") < 500), "no_complete_replacement")
        .when(~F.coalesce(setup, F.lit(False)) | F.col("payoff").isNull() | (F.col("doubts") > 0), "replacement_lacks_phases")
        .when((F.col("event_type") == "goal") & (F.col("outcome") != "goal"), "goal_replaced_by_non_goal")
        .when((end <= F.col("start_ms")) | (F.col("pick_start_ms") >= F.col("end_ms")), "other_incident"))
    return rows.select("match_id", "moment_id", why.alias("reason"), F.when(why.isNull(), F.col("pick_start_ms")).alias("start_ms"), F.when(why.isNull(), end).alias("end_ms"))


def render_queue(moments: DataFrame) -> DataFrame:
    """Locked scenes of matches where none is disabled; the others as one violation row each."""
    locked = moments.where(S.is_true("selection_locked"))
    off = locked.groupBy("match_id").agg(F.count(F.when(~S.is_true("selected"), 1)).alias("disabled"), F.count(F.lit(1)).alias("scenes"))
    return off.select("match_id", "scenes", F.when(F.col("disabled") > 0, "scene_disabled").alias("violation"))
