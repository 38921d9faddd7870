"""Joins: evidence, beats, companions, guides and annotations to moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.session import cut_lineage

from matchspark.functions.scalar import DECISIONS, SCORING, deferred, is_true, kept, length_ms, lookup, reaction, replay
from matchspark.operators.timeline import interval_join, nearest_within

ASPECT = 0.52


def nearest_record(events: DataFrame, records: DataFrame, tol_ms: int = 80) -> DataFrame:
    """Record closest in time to each event of the scene, within the tolerance."""
    return nearest_within(events, records, ["match_id", "scene_id"], "e_ms", "t_ms", tol_ms, ["frame", "ball_x"])


def enrich_with_annotations(moments: DataFrame, samples: DataFrame, shots: DataFrame, texts: DataFrame) -> DataFrame:
    """Sample counts, median focus, shot count and the first texts seen during each moment."""
    m = moments.select("match_id", "moment_id", "start_ms", "end_ms").withColumn("e1", F.col("end_ms") + 1)
    pts = samples.select("match_id", F.lower("label").alias("label"), F.col("t_ms").alias("p0"), (F.col("t_ms") + 1).alias("p1"), "x")
    hit = interval_join(m, pts, ["match_id"], ("start_ms", "e1"), ("p0", "p1"))
    ball, person = F.col("label").rlike("ball|football|soccer"), F.col("label").rlike("person|player|athlete")
    counts = hit.groupBy("match_id", "moment_id").agg(
        F.count(F.when(ball, 1)).alias("ball_samples"), F.count(F.when(person, 1)).alias("person_samples"),
        F.median(F.when(ball, F.col("x"))).alias("_bx"), F.median(F.when(person, F.col("x"))).alias("_px"),
    )
    seen = interval_join(m, shots.select("match_id", "shot_start_ms", "shot_end_ms"), ["match_id"], ("start_ms", "end_ms"), ("shot_start_ms", "shot_end_ms"))
    shot_n = seen.groupBy("match_id", "moment_id").agg(F.count(F.lit(1)).alias("shot_count"))
    words = interval_join(m, texts, ["match_id"], ("start_ms", "end_ms"), ("x_start_ms", "x_end_ms")).where("text <> ''")
    order = Window.partitionBy("match_id", "moment_id").orderBy("x_start_ms", "text_id")
    # one character and a space at least per text, so 351 texts always fill 700 characters
    listed = words.withColumn("rn", F.row_number().over(order)).where("rn <= 351")
    said = listed.groupBy("match_id", "moment_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("q")
    ).select(
        "match_id", "moment_id", F.concat_ws("|", F.slice(F.col("q.text"), 1, 12)).alias("texts"),
        F.substring(F.concat_ws(" ", F.col("q.text")), 1, 700).alias("transcript"),
    )
    keys = ["match_id", "moment_id"]
    out = moments.join(counts, keys, "left").join(shot_n, keys, "left").join(said, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *keys, zero("ball_samples"), zero("person_samples"), F.coalesce("_bx", "_px", "goal_focus_x").alias("focus_x"), zero("shot_count"),
        F.coalesce("texts", F.lit("")).alias("texts"), F.coalesce("transcript", F.lit("")).alias("transcript"),
    )


def label_frames(frames: DataFrame, phases: DataFrame) -> DataFrame:
    """Phase whose half-open span holds each frame."""
    pts = frames.withColumn("_n", F.col("t_ms") + 1)
    hit = interval_join(pts.select("match_id", "scene_id", "frame", "t_ms", "_n"), phases, ["match_id", "scene_id"], ("t_ms", "_n"), ("p_start_ms", "p_end_ms"))
    return frames.join(hit.select("match_id", "scene_id", "frame", "label"), ["match_id", "scene_id", "frame"], "left")


FRAME = ["match_id", "scene_id", "frame"]


def foot_distance(px: str, foot: str, bx: str, by: str, weight: float = ASPECT) -> Column:
    return F.sqrt(F.pow(F.col(px) - F.col(bx), 2) + F.pow((F.col(foot) - F.col(by)) * weight, 2))


def ball_proximity(balls: DataFrame, people: DataFrame, min_support: float = 0.08) -> DataFrame:
    """Distance from each ball to the nearest foot, over all people and over those on the pitch."""
    p = people.select(*FRAME, F.col("cx").alias("px"), F.col("y2").alias("foot"), F.col("pitch_support").alias("ps"))
    d = foot_distance("px", "foot", "cx", "cy")
    pair = balls.select(*FRAME, "idx", "cx", "cy").join(p, FRAME)
    near = pair.groupBy(*FRAME, "idx").agg(F.min(d).alias("any"), F.min(F.when(F.col("ps") >= min_support, d)).alias("pitch"))
    return near.select(*FRAME, "idx", F.round("any", 4).alias("near_any"), F.round(F.coalesce("pitch", F.lit(1.0)), 4).alias("near_pitch"))


def touch_distance_expr(weight: float = 0.85) -> Column:
    """Foot distance, or head distance when the ball is inside the head region (``bx``, ``by``)."""
    h = F.col("y2") - F.col("y1")
    in_head = (
        (h > 0) & F.col("bx").between(F.col("x1") - 0.012, F.col("x2") + 0.012)
        & F.col("by").between(F.col("y1") - 0.025, F.col("y1") + h * 0.18)
    )
    foot = F.sqrt(F.pow(F.col("cx") - F.col("bx"), 2) + F.pow((F.col("y2") - F.col("by")) * weight, 2))
    head = F.sqrt(F.pow(F.col("cx") - F.col("bx"), 2) + F.pow((F.col("y1") + h * 0.08 - F.col("by")) * weight, 2))
    return F.when(in_head, F.least(foot, head)).otherwise(foot)


def touch_distance(people: DataFrame, balls: DataFrame) -> DataFrame:
    b = balls.select(*FRAME, F.col("idx").alias("ball"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    return people.join(b, FRAME).select(*FRAME, "idx", "ball", F.round(touch_distance_expr(), 4).alias("touch"))


def match_evidence(moments: DataFrame, evidence: DataFrame, tol_ms: int = 41) -> DataFrame:
    """Tracking evidence whose interval agrees with the scene; reactions may end early."""
    pair = moments.join(evidence, ["match_id", "moment_id"])
    end = F.when(F.col("event_type") == "celebration", F.col("end_ms") <= F.col("ev_end_ms") + tol_ms).otherwise(
        F.abs(F.col("ev_end_ms") - F.col("end_ms")) <= tol_ms
    )
    return pair.where((F.abs(F.col("ev_start_ms") - F.col("start_ms")) <= tol_ms) & end)


def bind_beats(beats: DataFrame, moments: DataFrame) -> DataFrame:
    """The first beat naming each existing moment."""
    ids = moments.select("match_id", "moment_id")
    named = beats.where("beat_id <> '' AND trim(evidence_id) <> ''").withColumn("moment_id", F.trim("evidence_id"))
    return named.join(ids, ["match_id", "moment_id"], "left_semi").groupBy("match_id", "moment_id").agg(F.min_by("beat_id", "ordinal").alias("beat_id"))


def binding_problems(beats: DataFrame, moments: DataFrame) -> DataFrame:
    """Beats naming an unknown moment, or one an earlier beat already names."""
    named = beats.withColumn("moment_id", F.trim(F.coalesce("evidence_id", F.lit(""))))
    ids = moments.select("match_id", "moment_id")
    unknown = named.join(ids, ["match_id", "moment_id"], "left_anti").select("match_id", "beat_id", F.lit("unknown_id").alias("problem"))
    known = named.join(ids, ["match_id", "moment_id"], "left_semi")
    first = known.groupBy("match_id", "moment_id").agg(F.min("ordinal").alias("first"))
    again = known.join(first, ["match_id", "moment_id"]).where("ordinal > first").select("match_id", "beat_id", F.lit("id_reused").alias("problem"))
    return unknown.unionByName(again)


def bind_identities(goals: DataFrame, moments: DataFrame) -> DataFrame:
    """n-th reported goal to n-th distinct live incident, only where the counts agree.

    Stories are aggregated first; a match has as many as it has goals.
    """
    live = moments.where((F.col("event_type") == "goal") & is_true("semantic_verified") & is_true("action_complete") & kept() & ~replay())
    first = live.groupBy("match_id", "story_id").agg(F.min_by("moment_id", F.struct("start_ms", "ordinal")).alias("moment_id"), F.min(F.struct("start_ms", "ordinal")).alias("at"))
    rank = Window.partitionBy("match_id").orderBy("at")
    incident = first.withColumn("n", F.row_number().over(rank))
    listed = goals.withColumn("n", F.row_number().over(Window.partitionBy("match_id").orderBy("minute", "goal_id")))
    size = lambda df, c: df.groupBy("match_id").agg(F.count(F.lit(1)).alias(c))
    even = size(incident, "a").join(size(listed, "b"), "match_id").where("a = b")
    return incident.join(listed, ["match_id", "n"]).join(even, "match_id", "left_semi").select("match_id", "n", "story_id", "moment_id", "goal_id", "scorer")


def attach_reactions(moments: DataFrame) -> DataFrame:
    """One celebration per goal story: the first starting within [-0.1, +1] s of a goal's end."""
    ok = moments.where(is_true("semantic_verified") & is_true("action_complete") & kept())
    goal_ends = ok.where(F.col("event_type") == "goal").select("match_id", "story_id", (F.col("end_ms") - 100).alias("g0"), (F.col("end_ms") + 1_001).alias("g1")).distinct()
    cheer = ok.where(F.col("event_type") == "celebration").select("match_id", "story_id", "moment_id", "ordinal", F.col("start_ms").alias("c0"), (F.col("start_ms") + 1).alias("c1"))
    near = interval_join(cheer, goal_ends, ["match_id", "story_id"], ("c0", "c1"), ("g0", "g1"))
    return near.groupBy("match_id", "story_id").agg(F.min_by("moment_id", "ordinal").alias("moment_id"))


def decision_windows(moments: DataFrame, limit: int = 3, reach_ms: int = 45_000) -> DataFrame:
    """Up to three later decision clips of the same story."""
    d = moments.where(is_true("semantic_verified") & F.col("event_type").isin(*DECISIONS)).select(
        "match_id", "story_id", F.col("moment_id").alias("decision_id"), F.col("ordinal").alias("d_ord"),
        F.col("start_ms").alias("d_start_ms"), (F.col("start_ms") + 1).alias("d1"), F.col("end_ms").alias("d_end_ms"),
    )
    m = moments.where(F.col("event_type").isin(*SCORING)).select("match_id", "story_id", "moment_id", "end_ms", (F.col("end_ms") + reach_ms + 1).alias("upto"))
    pair = interval_join(m, d, ["match_id", "story_id"], ("end_ms", "upto"), ("d_start_ms", "d1")).where("decision_id <> moment_id")
    order = Window.partitionBy("match_id", "moment_id").orderBy("d_ord")
    return pair.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("match_id", "moment_id", "rn", "decision_id", "d_start_ms", "d_end_ms")


def overturn_goals(moments: DataFrame, reach_ms: int = 45_000) -> DataFrame:
    """Verified goals whose same-story decision says the goal is ruled out.

    Decisions only matter through their start time, so they are reduced to one
    row per story and instant before the range join.
    """
    says = moments.where(
        is_true("semantic_verified") & F.col("event_type").isin(*DECISIONS) & F.col("facts").rlike("(?i)disallow|overturn|no goal|ruled out")
    ).groupBy("match_id", "story_id", F.col("start_ms").alias("d0")).agg(F.min(F.struct("ordinal", F.col("moment_id").alias("id"))).alias("d"))
    goals = moments.where((F.col("event_type") == "goal") & is_true("semantic_verified")).select(
        "match_id", "story_id", "moment_id", "start_ms", (F.col("end_ms") + reach_ms + 1).alias("upto"))
    near = interval_join(goals, says.withColumn("d1", F.col("d0") + 1), ["match_id", "story_id"], ("start_ms", "upto"), ("d0", "d1"))
    hit = near.groupBy("match_id", "moment_id").agg(F.min("d").alias("d")).select("match_id", "moment_id", F.col("d.id").alias("decision_id"))
    return moments.join(hit, ["match_id", "moment_id"], "left").withColumn(
        "event_type", F.when(F.col("decision_id").isNotNull(), "disallowed_goal").otherwise(F.col("event_type"))
    )


def same_action_ok() -> Column:
    """The row can take part in ``same_action_pairs``: valid contact and result clocks."""
    ok = (
        is_true("semantic_verified") & is_true("action_complete") & ~reaction() & (F.col("end_ms") > F.col("start_ms")) & is_true("proof_verified")
        & F.col("contact_ms").between(F.col("start_ms"), F.col("end_ms")) & (F.col("proof_start_ms") >= F.col("contact_ms"))
        & (F.col("proof_end_ms") >= F.col("proof_start_ms")) & (F.col("proof_end_ms") <= F.col("end_ms"))
    )
    return F.coalesce(ok, F.lit(False))


def same_action_pairs(moments: DataFrame) -> DataFrame:
    """Pairs observed at the same contact (.35 s) and result (.5 s) and overlapping by 35 %.

    Contacts within .35 s of each other are found by joining narrow contact
    windows, not by pairing a whole match.
    """
    rows = moments.where(same_action_ok())
    cols = ["match_id", "moment_id", "ordinal", "start_ms", "end_ms", "contact_ms", "proof_start_ms", "proof_end_ms"]
    a = rows.select(*cols).withColumns(dict(w0=F.col("contact_ms") - 350, w1=F.col("contact_ms") + 351))
    b = rows.select("match_id", *[F.col(c).alias("b_" + c) for c in cols[1:]]).withColumns(dict(v0=F.col("b_contact_ms"), v1=F.col("b_contact_ms") + 1))
    pair = interval_join(a, b, ["match_id"], ("w0", "w1"), ("v0", "v1"), bin_ms=2_000).where("ordinal < b_ordinal")
    shared = F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")
    short = F.least(length_ms(), F.col("b_end_ms") - F.col("b_start_ms"))
    ok = (
        (shared >= short * 0.35) & (F.abs(F.col("proof_start_ms") - F.col("b_proof_start_ms")) <= 500)
        & (F.least("proof_end_ms", "b_proof_end_ms") >= F.greatest("proof_start_ms", "b_proof_start_ms"))
    )
    return pair.where(ok).select("match_id", F.col("moment_id").alias("a_id"), F.col("b_moment_id").alias("b_id"))


def section_of(moments: DataFrame, sections: DataFrame) -> DataFrame:
    """Section whose core holds the midpoint of each moment."""
    mid = moments.select("match_id", "moment_id", (F.col("start_ms") + F.col("end_ms")).alias("m0")).withColumn("m1", F.col("m0") + 1)
    core = sections.select("match_id", "section", (F.col("start_ms") * 2).alias("c0"), (F.col("core_end_ms") * 2).alias("c1"))
    return interval_join(mid, core, ["match_id"], ("m0", "m1"), ("c0", "c1"), bin_ms=360_000).select("match_id", "moment_id", "section")


def missing_reviews(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected ids returned not exactly once, or without both verdict flags."""
    got = returned.groupBy("match_id", "moment_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("r_verified").isNotNull() & F.col("r_complete").isNotNull()).alias("full"))
    ok = (F.col("n") == 1) & F.col("full")
    return expected.join(got, ["match_id", "moment_id"], "left").where(~F.coalesce(ok, F.lit(False))).select(
        "match_id", "moment_id", F.coalesce("n", F.lit(0)).alias("returned"))


# Outcome of a source guide to event type.
GUIDE_OUTCOMES = {
    "save": "save", "wide": "shot_off_target", "over": "shot_off_target", "blocked": "big_chance", "woodwork": "big_chance",
    "pass": "normal_play", "dribble": "dribble", "tackle": "tackle",
}
NON_GOAL = ["save", "wide", "over", "blocked", "woodwork"]


def _times(anchors: Column, cond) -> Column:
    return F.transform(F.filter(anchors, cond), lambda a: a["t"])


def guided_bounds(moments: DataFrame) -> DataFrame:
    """New end, type and phase clocks from a source guide, or the reason it cannot be used.

    ``guide`` is an array of at most six ``struct(t, phase, ball, player)`` on the
    source clock, so everything is array algebra inside the row.
    """
    g = F.col("guide")
    touches = _times(g, lambda a: (a["phase"] == "contact") & a["ball"] & a["player"])
    first_touch = F.array_min(touches)
    payoff = F.array_min(_times(g, lambda a: (a["phase"] == "payoff") & a["ball"] & (a["t"] > first_touch) & (a["t"] >= F.col("start_ms"))))
    rows = moments.withColumns(dict(_touches=touches, _payoff=payoff))
    contact = F.array_max(F.filter("_touches", lambda t: t < F.col("_payoff")))
    rows = rows.withColumn("_contact", contact)
    setup = F.array_min(_times(g, lambda a: a["phase"].isin("setup", "flight", "contact") & a["ball"] & a["player"] & (a["t"] < F.col("_contact"))))
    rows = rows.withColumn("_setup", setup)
    scoring = F.col("event_type").isin(*SCORING)
    found = F.col("_contact").isNotNull() & F.col("_payoff").isNotNull()
    correct = scoring & F.col("outcome").isin(*NON_GOAL) & is_true("authoritative") & (F.col("doubts") == 0) & found
    early = is_true("semantic_verified") & is_true("action_complete") & (F.col("origin_ms") < F.col("_contact"))
    end = F.least("window_end_ms", F.greatest("end_ms", F.col("_payoff") + 500))
    reason = (
        F.when(reaction(), None)
        .when(scoring & (F.col("outcome") != "goal") & ~F.coalesce(correct, F.lit(False)), "source_goal_outcome_unresolved")
        .when(~scoring & (F.col("outcome") == "goal"), "optional_action_goal_context_conflict")
        .when(
            (F.col("outcome") == "uncertain") | ~found | (F.col("_setup").isNull() & ~F.coalesce(early, F.lit(False))),
            "source_action_has_no_observed_complete_phases")
        .when(end - F.col("start_ms") < 500, "source_action_too_short")
    )
    use = reason.isNull() & ~reaction()
    new_type = F.when(use, F.coalesce(lookup(GUIDE_OUTCOMES, F.col("outcome")), F.col("event_type"))).otherwise(F.col("event_type"))
    return rows.select(
        "match_id", "moment_id", reason.alias("reason"), F.when(reason.isNull(), F.when(use, end).otherwise(F.col("end_ms"))).alias("end_ms"),
        F.when(reason.isNull(), new_type).alias("event_type"), F.when(use, F.greatest("start_ms", F.coalesce("_setup", "origin_ms"))).alias("origin_ms"),
        F.when(use, F.col("_contact")).alias("contact_ms"), F.when(use, F.array_min(F.filter("_touches", lambda t: t < F.col("_payoff")))).alias("flight_ms"),
        F.when(use, F.col("_payoff")).alias("payoff_ms"),
    )


def guide_brief(moments: DataFrame) -> DataFrame:
    """Search hints from a guide: opening focus, contact, first flight, destination and attack side.

    Guide structs also carry ``ball_x`` and ``goal_x`` (null when not visible).
    """
    g = F.col("guide")
    pick = lambda cond, last=False: F.try_element_at(F.filter(g, cond), F.lit(-1 if last else 1))
    start = pick(lambda a: a["ball_x"].isNotNull())
    touch = pick(lambda a: a["ball_x"].isNotNull() & (a["phase"] == "contact"), True)
    first_touch = pick(lambda a: a["ball_x"].isNotNull() & (a["phase"] == "contact"))
    flight = pick(lambda a: a["ball_x"].isNotNull() & (a["phase"] == "flight"))
    finish = pick(lambda a: (a["phase"] == "payoff") & a["goal_x"].isNotNull())
    shot = F.col("outcome").isin("goal", *NON_GOAL) & finish.isNotNull() & touch.isNotNull()
    real_goal = (F.col("event_type") == "goal") & (F.col("outcome") == "goal")
    dest = F.when(real_goal, finish["goal_x"]).otherwise(F.coalesce(finish["ball_x"], finish["goal_x"]))
    return moments.select(
        "match_id", "moment_id", F.when(start["t"] - F.col("start_ms") <= 800, start["ball_x"]).alias("opening_x"), touch["t"].alias("contact_ms"),
        F.when(touch.isNotNull(), F.least(first_touch["t"], F.coalesce(flight["t"], first_touch["t"]))).alias("flight_ms"),
        F.when(shot, dest).alias("goal_focus_x"), F.when(shot, F.when(dest > touch["ball_x"], "right").otherwise("left")).alias("attack_direction"),
        F.when(shot, finish["t"]).alias("payoff_start_ms"), (shot & real_goal).alias("proof"),
    )


# Events whose outcome another angle can show.
OUTCOME_EVENTS = ["goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance"]


def alternate_angles(moments: DataFrame, k: int = 2) -> DataFrame:
    """Up to ``k`` other clips of a moment's incident that overlap neither it nor each other by more than .25 s.

    Needs ``anchor_id`` and ``segments``. An incident is its score anchor, else its story. Verified clips come first,
    then those with fewer camera segments, then the closest in time. Each step is a ``min_by`` over the clips left, so
    no list of an incident is held; only clips within reach of the rank can meet a moment.
    """
    other = moments.where(
        F.col("event_type").isin(*OUTCOME_EVENTS) & (is_true("score_observation") | is_true("semantic_verified")) & is_true("action_complete")
        & (F.col("end_ms") > F.col("start_ms")) & (length_ms() <= 30_000)
    ).select(
        "match_id", F.col("moment_id").alias("o_id"), F.col("ordinal").alias("o_ordinal"), F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"), F.col("anchor_id").alias("o_anchor"),
        F.col("story_id").alias("o_story"), F.when(is_true("semantic_verified"), 0).otherwise(1).alias("o_class"), F.coalesce("segments", F.lit(1)).alias("o_segments"),
        (is_true("is_replay") | F.coalesce(F.col("story_phase") == "replay", F.lit(False))).alias("o_replay"),
    )
    own = moments.select("match_id", "moment_id", "anchor_id", "story_id", "start_ms", "end_ms")
    by_anchor = own.where("anchor_id IS NOT NULL").join(other.where("o_anchor IS NOT NULL").withColumn("anchor_id", F.col("o_anchor")), ["match_id", "anchor_id"])
    by_story = own.where("anchor_id IS NULL AND story_id IS NOT NULL").join(other.withColumn("story_id", F.col("o_story")), ["match_id", "story_id"])
    cols = ["match_id", "moment_id", "start_ms", "end_ms", "o_id", "o_ordinal", "o_start", "o_end", "o_class", "o_segments", "o_replay"]
    apart = F.least("o_end", "end_ms") - F.greatest("o_start", "start_ms") <= 250
    left = by_anchor.select(*cols).unionByName(by_story.select(*cols)).where((F.col("o_id") != F.col("moment_id")) & apart)
    rank = F.struct("o_class", "o_segments", F.abs(F.col("o_start") - F.col("start_ms")), "o_ordinal")
    out = None
    for place in range(1, k + 1):
        pick = F.min_by(F.struct("o_id", "o_start", "o_end", "o_replay"), rank).alias("best")
        best = cut_lineage(left.groupBy("match_id", "moment_id").agg(pick))
        rows = best.select("match_id", "moment_id", F.lit(place).alias("place"), F.col("best.o_id").alias("angle_id"), F.col("best.o_start").alias("angle_start_ms"), F.col("best.o_end").alias("angle_end_ms"), F.col("best.o_replay").alias("angle_replay"))
        out = rows if out is None else out.unionByName(rows)
        free = F.least("o_end", "best.o_end") - F.greatest("o_start", "best.o_start") <= 250
        left = left.join(best, ["match_id", "moment_id"]).where(free & (F.col("o_id") != F.col("best.o_id"))).select(*cols)
    return out
