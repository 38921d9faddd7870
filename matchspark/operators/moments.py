"""Projections and predicates over candidate moments: one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.scalar import (
    EVENT_WEIGHTS, SHOTS, clamp, deferred, half_up, is_true, kept, length_ms, lookup, not_false, reaction, replay,
)
from matchspark.operators.timeline import interval_join


def score_moments(moments: DataFrame) -> DataFrame:
    """Editorial importance from event weight, visibility, confidence and duplication."""
    raw = (
        lookup(EVENT_WEIGHTS, F.col("event_type"))
        + F.when(is_true("ball_visible"), 5).otherwise(-14)
        + F.when(is_true("player_visible"), 4).otherwise(-10)
        + (F.col("confidence") - 0.5) * 14
        - F.when(F.coalesce(F.col("duplicate_group"), F.lit("")) != "", 8).otherwise(0)
    )
    return moments.withColumn("importance", clamp(half_up(raw), 0, 100))


def issues(*pairs: tuple[str, Column]) -> Column:
    """Sorted text list of the codes whose condition holds."""
    flags = [F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in pairs]
    return F.array_join(F.array_sort(F.array_compact(F.array(*flags))), ",")


def observation_problems(moments: DataFrame, duration_ms: int, slack_ms: int = 50) -> DataFrame:
    """Every reason a first observation cannot be used, as a code list.

    ``shot_count``, ``setup_text``, ``continuation_text``, ``result_text``, ``outcome`` and ``*_seen`` columns describe the
    observation; all four texts must be there.
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    clocks = [F.col(c) for c in ("origin_ms", "contact_ms", "flight_ms", "payoff_start_ms", "payoff_end_ms")]
    origin, contact, flight, p0, p1 = clocks
    outside = [c.isNull() | (c < start) | (c > end) for c in clocks]
    bad_clock = outside[0] | outside[1] | outside[2] | outside[3] | outside[4]
    bad_clock = bad_clock | (origin > contact) | (origin > flight) | (origin > p0) | (contact > p1) | (flight > p1) | (p0 > p1)
    unseen = ~(
        is_true("ball_visible") & is_true("player_visible") & is_true("initiator_seen")
        & is_true("continuation_seen") & is_true("result_seen")
    )
    act = ~reaction()
    return moments.withColumn(
        "problems",
        issues(
            ("invalid_excerpt_clock", (start < 0) | (end > duration_ms + slack_ms) | (length_ms() < 500)),
            ("missing_camera_shots", F.coalesce(F.col("shot_count"), F.lit(0)) < 1),
            ("missing_incident_id", F.trim(F.coalesce("story_id", F.lit(""))) == ""),
            ("invalid_confidence", ~F.col("confidence").between(0, 1)),
            ("incomplete_action", ~is_true("action_complete") | ~kept()),
            ("missing_source_description", F.least(*[F.length(F.trim(F.coalesce(c, F.lit("")))) for c in ("setup_text", "continuation_text", "result_text", "outcome")]) == 0),
            ("outcome_class_conflict", ~F.col("outcome").eqNullSafe(F.col("event_type"))),
            ("missing_visible_action_phase", act & unseen),
            ("invalid_action_phase_clock", act & bad_clock),
            ("unobserved_reaction", ~act & ~is_true("result_seen")),
        ),
    )


def quarantine_drafts(drafts: DataFrame, duration_ms: int, extra_events: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split drafts into usable rows and a side table with reasons."""
    start, end = F.col("start_ms"), F.col("end_ms")
    clock = start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > duration_ms + 50)
    meta = (
        clock | ~F.col("confidence").between(0, 1) | ~F.col("keep_decision").isin("keep", "support", "replay", "reject")
        | ~F.col("story_phase").isin("action", "reaction", "replay") | ~F.col("event_type").isin(*extra_events)
        | (F.trim(F.coalesce("story_id", F.lit(""))) == "") | F.col("action_complete").isNull() | F.col("is_replay").isNull()
    )
    checked = drafts.withColumn("reasons", issues(("invalid_excerpt_local_clock", clock), ("invalid_scene_metadata", meta)))
    return checked.where("reasons = ''").drop("reasons"), checked.where("reasons <> ''")


def _phase(c: str, ratio_pct: Column | int) -> Column:
    fallback = F.col("start_ms") + F.floor(F.greatest(length_ms(), F.lit(1)) * ratio_pct / 100)
    return F.least(F.col("end_ms"), F.greatest(F.col("start_ms"), F.coalesce(F.col(c), fallback)))


def normalize_brief(moments: DataFrame) -> DataFrame:
    """Fill missing phase clocks by ratio, clamp to the scene and force their order; the annotation spans the contact."""
    origin = _phase("origin_ms", 6)
    contact = _phase("contact_ms", F.when(reaction(), 18).otherwise(34))
    flight = F.greatest(origin, _phase("flight_ms", 38))
    handoff = F.greatest(flight, _phase("handoff_ms", 50))
    p0 = F.greatest(contact, handoff, _phase("payoff_start_ms", 68))
    p1 = F.greatest(p0, _phase("payoff_end_ms", 94))
    mode = F.when(
        F.col("camera_mode").isin("stable", "joint_follow", "ball_flight", "goal_hold", "reaction"), F.col("camera_mode")
    ).when(reaction(), "reaction").when(F.col("event_type") == "goal", "goal_hold").otherwise("joint_follow")
    goal = F.col("event_type") == "goal"
    a0 = F.when(goal & F.col("annotation_start_ms").isNull(), F.greatest(F.col("start_ms"), contact - 1200)).otherwise(_phase("annotation_start_ms", 8))
    a1 = F.when(goal & F.col("annotation_end_ms").isNull(), F.least(F.col("end_ms"), contact + 450)).otherwise(F.greatest(a0, F.least(contact + 650, _phase("annotation_end_ms", 42))))
    return moments.withColumns(
        dict(origin_ms=origin, contact_ms=contact, flight_ms=flight, handoff_ms=handoff, payoff_start_ms=p0,
             payoff_end_ms=p1, camera_mode=mode, annotation_start_ms=a0, annotation_end_ms=a1)
    )


def _box_ok() -> Column:
    edges = [F.col(c) for c in ("box_x1", "box_y1", "box_x2", "box_y2")]
    inside = edges[0].between(0, 1) & edges[1].between(0, 1) & edges[2].between(0, 1) & edges[3].between(0, 1)
    return F.coalesce(inside & (edges[0] < edges[2]) & (edges[1] < edges[3]), F.lit(False))


def payoff_window(moments: DataFrame) -> DataFrame:
    """``window_start_ms``/``window_end_ms`` of a proven outcome inside the scene, else null."""
    lo = F.greatest("start_ms", "proof_start_ms")
    hi = F.least("end_ms", "proof_end_ms")
    ok = is_true("proof_verified") & F.col("proof_event").eqNullSafe(F.col("event_type")) & _box_ok() & (hi - lo >= 500)
    return moments.withColumn("window_start_ms", F.when(ok, lo)).withColumn("window_end_ms", F.when(ok, hi))


def orient_payoff_box(moments: DataFrame) -> DataFrame:
    """Mirror a proven goal box lying opposite the attack, and take the focus from it."""
    proven = payoff_window(moments)
    goal = (F.col("event_type") == "goal") & F.col("window_start_ms").isNotNull()
    centre = (F.col("box_x1") + F.col("box_x2")) / 2
    flip = goal & (
        ((F.col("attack_direction") == "right") & (centre < 0.45)) | ((F.col("attack_direction") == "left") & (centre > 0.55))
    )
    x1 = F.when(flip, 1 - F.col("box_x2")).otherwise(F.col("box_x1"))
    x2 = F.when(flip, 1 - F.col("box_x1")).otherwise(F.col("box_x2"))
    focus = F.when(goal, (x1 + x2) / 2).otherwise(clamp(F.col("goal_focus_x"), 0.0, 1.0))
    focus = F.when(~goal & F.col("goal_focus_x").isNull(), None).otherwise(focus)
    return proven.withColumns(dict(new_x1=x1, new_x2=x2, focus_x=focus)).drop("box_x1", "box_x2").withColumnsRenamed(
        {"new_x1": "box_x1", "new_x2": "box_x2"}
    )


PHASE_CLOCKS = ["origin_ms", "contact_ms", "flight_ms", "handoff_ms", "payoff_start_ms", "payoff_end_ms", "proof_start_ms", "proof_end_ms"]


def to_scene_clock(moments: DataFrame) -> DataFrame:
    """Move every phase clock from the source to the scene."""
    shifted = {c.replace("_ms", "_loc_ms"): F.col(c) - F.col("start_ms") for c in PHASE_CLOCKS}
    return moments.withColumns({**shifted, "length_ms": length_ms()})


def action_phase(records: DataFrame) -> DataFrame:
    """setup, contact, flight or payoff by elapsed time; a release may precede the touch."""
    t, contact, flight, payoff = (F.col(c) for c in ("t_ms", "contact_ms", "flight_ms", "payoff_ms"))
    early = (
        F.when(t < flight, "setup").when(t.between(contact - 150, contact + 120), "contact").otherwise("flight")
    )
    normal = F.when(t < contact, "setup").when(t < flight, "contact").otherwise("flight")
    return records.withColumn(
        "action_phase", F.when(t >= payoff, "payoff").when(flight < contact, early).otherwise(normal)
    )


def edit_plan(picked: DataFrame, masks: DataFrame, intensity: str = "dynamic", audio: str = "reduced") -> DataFrame:
    """Ordered segments with focus, gain and effects for the selected moments.

    Selection is bounded by the time budget, so the ordering window is small.
    """
    clips = picked.where("selected")
    hits = (
        interval_join(
            clips.select("match_id", "moment_id", "start_ms", "end_ms"),
            masks.where("mask_confidence >= 0.72").select("match_id", "first_ms", "last_ms"),
            ["match_id"], ("start_ms", "end_ms"), ("first_ms", "last_ms"),
        )
        .groupBy("match_id", "moment_id").agg(F.count(F.lit(1)).alias("mask_count"))
    )
    from pyspark.sql import Window

    order = Window.partitionBy("match_id").orderBy("start_ms", "ordinal")
    n = F.coalesce("mask_count", F.lit(0))
    effects = F.array_compact(
        F.array(
            F.lit("dynamic_crop"),
            F.when(is_true("player_visible"), "highlight"),
            F.when(F.coalesce("commentary", F.lit("")) != "", "caption"),
            F.when(n > 0, "overlay_blur"),
            F.when(F.lit(intensity != "natural") & F.col("event_type").isin("goal", "save", "big_chance"), "zoom"),
        )
    )
    gain = {"muted": 0.0, "reduced": 0.28}.get(audio, 1.0)
    return clips.join(hits, ["match_id", "moment_id"], "left").select(
        "match_id", F.row_number().over(order).alias("segment"), "moment_id", "event_type", "start_ms", "end_ms",
        F.coalesce("focus_x", F.lit(0.5)).alias("focus_x"), F.lit(gain).alias("audio_gain"),
        n.alias("mask_count"), F.array_join(effects, ",").alias("effects"),
    )


def select_masks(moments: DataFrame, masks: DataFrame) -> DataFrame:
    """Confident overlay masks alive during each moment."""
    return interval_join(
        moments.select("match_id", "moment_id", "start_ms", "end_ms"),
        masks.where("mask_confidence >= 0.72"), ["match_id"], ("start_ms", "end_ms"), ("first_ms", "last_ms"),
    )


def duration_bounds(sources: DataFrame) -> DataFrame:
    """Natural maximum length by source length; short sources carry a problem code."""
    d = F.greatest("duration_ms", F.lit(0))
    top = F.when(d <= 300_000, F.least(F.lit(90_000), d)).when(d <= 420_000, 120_000).when(d <= 900_000, 240_000).otherwise(300_000)
    return sources.select(
        "match_id", "duration_ms", F.lit(0).cast("long").alias("min_ms"), top.cast("long").alias("max_ms"),
        F.when(F.col("duration_ms") <= 0, "unreadable_duration").when(F.col("duration_ms") < 180_000, "shorter_than_three_minutes").alias("problem"),
    )


def buildup_eligible(moments: DataFrame) -> DataFrame:
    """Complete passing passages usable as a reserve. Needs ``fact_count`` and ``ball_phases``."""
    inside = lambda c: F.col(c).between(F.col("start_ms"), F.col("end_ms"))
    ok = (
        is_true("additional_action") & F.col("event_type").isin("normal_play", "assist", "dribble")
        & is_true("semantic_verified") & is_true("action_complete") & kept() & not_false("ball_visible")
        & not_false("player_visible") & (F.coalesce("visual_clarity", F.lit(0.0)) >= 70) & (F.col("fact_count") >= 2)
        & F.array_contains("ball_phases", "setup") & F.array_contains("ball_phases", "payoff")
        & inside("origin_ms") & inside("contact_ms") & inside("payoff_end_ms")
        & (F.col("origin_ms") < F.col("contact_ms")) & (F.col("contact_ms") < F.col("payoff_end_ms"))
    )
    return moments.withColumn("buildup_eligible", F.coalesce(ok, F.lit(False)))


def static_eligible() -> Column:
    return (
        is_true("semantic_verified") & is_true("action_complete") & reaction() & is_true("player_visible")
        & (F.coalesce("confidence", F.lit(0.0)) >= 0.84) & (F.coalesce("visual_clarity", F.lit(0.0)) >= 70)
    )


def static_fallback(moments: DataFrame) -> DataFrame:
    """Reopen rejected reaction shots as a stable presentation."""
    hit = ~kept() & static_eligible()
    why = F.coalesce("tracking_decision", F.lit("tracking_unavailable"))
    anchored = F.col("contact_ms").isNotNull() | F.col("payoff_start_ms").isNotNull()
    look = (
        F.when((F.col("effect") == "freeze_analysis") & anchored, "freeze_analysis").when(replay(), "replay_treatment")
        .when(F.col("event_type").isin(*SHOTS), "slow_motion").otherwise("none")
    )
    return moments.withColumns(
        dict(
            static_view=hit,
            keep_decision=F.when(hit, F.when(replay(), "replay").otherwise("keep")).otherwise(F.col("keep_decision")),
            tracking_decision=F.when(hit, F.concat(F.lit("safe_static_"), why)).otherwise(F.col("tracking_decision")),
            reject_reason=F.when(~hit, F.col("reject_reason")),
            effect=F.when(hit, look).otherwise(F.col("effect")),
        )
    )


def decision_relabel(moments: DataFrame) -> DataFrame:
    """A disallowed goal seen only as a referee decision becomes a review scene.

    ``required`` is the array of ``struct(phase, subjects)``; ``facts`` the narration facts.
    """
    play = ["ball", "goal_mouth", "receiver", "goalkeeper"]
    bad = lambda r: (
        ~r["phase"].isin("reaction", "decision") | (F.coalesce(F.size(r["subjects"]), F.lit(0)) < 1)
        | F.exists(r["subjects"], lambda s: s.isin(*play))
    )
    hit = (
        (F.col("event_type") == "disallowed_goal") & is_true("semantic_verified") & is_true("action_complete")
        & F.col("camera_mode").isin("reaction", "decision", "referee") & F.col("proof_start_ms").isNull()
        & (F.size("required") > 0) & ~F.exists("required", bad)
        & F.exists("facts", lambda f: f.rlike(r"(?i)\b(?:referee|VAR|offside|monitor)\b"))
    )
    hit = F.coalesce(hit, F.lit(False))
    return moments.withColumns(
        dict(
            relabelled=hit,
            event_type=F.when(hit, "var").otherwise(F.col("event_type")),
            story_phase=F.when(hit, "reaction").otherwise(F.col("story_phase")),
        )
    )


def cap_reactions(moments: DataFrame, limit_ms: int = 3000) -> DataFrame:
    """Unlocked reactions end within the limit at normal speed."""
    free = reaction() & ~is_true("selection_locked")
    return moments.withColumns(
        dict(
            end_ms=F.when(free, F.least("end_ms", F.col("start_ms") + limit_ms)).otherwise(F.col("end_ms")),
            playback_rate=F.when(free, 1.0).otherwise(F.col("playback_rate")),
        )
    )


def validate_settings(jobs: DataFrame) -> DataFrame:
    """Enum checks and per-style defaults; ``problem`` marks jobs for quarantine."""
    style = F.coalesce("edit_style", F.lit("complete_highlights"))
    audio = F.coalesce("original_audio", F.lit("reduced"))
    pace = F.coalesce("intensity", F.lit("dynamic"))
    viral = style == "viral_reel"
    full = style == "complete_highlights"
    problem = (
        F.when(~audio.isin("normal", "reduced", "muted"), "INVALID_AUDIO_MODE")
        .when(~pace.isin("natural", "dynamic", "high_energy"), "INVALID_INTENSITY")
        .when(~style.isin("complete_highlights", "viral_reel", "tactical_analysis"), "INVALID_EDIT_STYLE")
    )
    ratio = F.when(viral, "4:5").when(F.col("aspect_ratio").isin("1:1", "4:3", "9:16", "16:9"), F.col("aspect_ratio")).otherwise("9:16")
    return jobs.withColumns(
        dict(
            problem=problem, edit_style=style, original_audio=audio, intensity=pace, aspect_ratio=ratio,
            target_s=F.when(viral, 36).when(full, 60).otherwise(0),
            min_s=F.when(full, 60).when(viral, 30).otherwise(0),
        )
    )


def media_preflight(scenes: DataFrame, probes: DataFrame) -> DataFrame:
    """Compare a rendered file's length with its scene."""
    expected = F.col("end_ms") - F.col("start_ms")
    tol = F.greatest(F.lit(100.0), F.lit(2000.0) / F.greatest(F.lit(1.0), F.col("fps")))
    issue = (
        F.when(expected <= 0, "invalid_locked_scene_clock")
        .when(F.coalesce("media_ms", F.lit(0)) <= 0, "invalid_rendered_crop_media")
        .when(F.abs(F.col("media_ms") - expected) > tol, "rendered_crop_duration_mismatch")
    )
    return scenes.join(probes, ["match_id", "moment_id"], "left").select(
        "match_id", "moment_id", issue.alias("issue"), issue.isNull().alias("usable")
    )


# Masks of the broadcast interface and of the usual corner mark (x, y, width, height).
UI_MASKS = [("broadcast-scorebug", 0.005, 0.006, 0.275, 0.085), ("broadcast-header", 0.345, 0.004, 0.31, 0.072), ("broadcast-channel-bug", 0.775, 0.006, 0.22, 0.095)]
CORNER_MASK = ("fallback-top-right-watermark", 0.875, 0.012, 0.115, 0.145)


def default_masks(matches: DataFrame, masks: DataFrame) -> DataFrame:
    """Detected masks and interface masks where asked for; one corner mask where neither exists."""
    own = masks.where("width > 0 AND height > 0").select("match_id", "mask_id", "width", "height")
    row = lambda m: F.struct(F.lit(m[0]).alias("mask_id"), F.lit(m[3]).alias("width"), F.lit(m[4]).alias("height"))
    ui = matches.where("ui_masks").select("match_id", F.inline(F.array(*[row(m) for m in UI_MASKS])))
    have = own.unionByName(ui)
    corner = matches.join(have.select("match_id").distinct(), "match_id", "left_anti").select("match_id", F.inline(F.array(row(CORNER_MASK))))
    return have.unionByName(corner)


def decode_boxes(obs: DataFrame) -> DataFrame:
    """Boxes given as y, x, y, x in 0..1000 to x1, y1, x2, y2 in 0..1, with an issue when unusable."""
    at = lambda i: F.try_element_at("box", F.lit(i)) / 1000
    y1, x1, y2, x2 = (at(i) for i in (1, 2, 3, 4))
    ok = F.coalesce((F.size("box") == 4) & (x1 >= 0) & (y1 >= 0) & (x2 <= 1) & (y2 <= 1) & (x2 > x1) & (y2 > y1), F.lit(False))
    good = lambda c: F.when(ok, c)
    return obs.withColumns(dict(x1=good(x1), y1=good(y1), x2=good(x2), y2=good(y2), issue=F.when(F.col("box").isNotNull() & ~ok, "invalid_box")))
