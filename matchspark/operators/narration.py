"""Narration: sections, slots, cues, packets and manifests of an edited match.

Everything here runs on the edited selection, whose size the time budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.functions.text import concise, concise_caption, sentence, word_count
from matchspark.operators.timeline import scan


def normalize_plan(beats: DataFrame) -> DataFrame:
    """Clean beats: safe ids, one-line sentences, headline captions; empty narrations dropped."""
    ident = F.substring(F.regexp_replace(F.coalesce("beat_id", F.concat(F.lit("beat-"), (F.col("ordinal") + 1).cast("string"))), "[^a-zA-Z0-9_-]", "-"), 1, 48)
    clean = beats.select("match_id", "ordinal", ident.alias("beat_id"), F.coalesce("role", F.lit("analysis")).alias("role"), sentence(F.col("narration")).alias("narration"),
                         concise_caption(F.col("caption"), F.col("role")).alias("caption"))
    return clean.where("narration <> ''").withColumn("words", word_count(F.col("narration")))


def continuous_script(beats: DataFrame) -> DataFrame:
    """The beats of one edit as a single text in order."""
    rows = beats.where("trim(coalesce(narration, '')) <> ''").select("match_id", F.struct("ordinal", sentence(F.col("narration")).alias("s")).alias("b"))
    return rows.groupBy("match_id").agg(F.sort_array(F.collect_list("b")).alias("q")).select("match_id", F.array_join("q.s", " ").alias("script"))


def narration_sections(scenes: DataFrame, block: Column) -> DataFrame:
    """Join linked reaction scenes to the preceding section of their story.

    ``scenes`` carries ``slot``, output clock and narration; a section spans a few scenes.
    """
    seen = scan(scenes, ["match_id"], ["slot"], block, prior={"_story": ("last", F.col("story_id"))})
    joins = F.coalesce((F.col("_story") == F.col("story_id")) & F.col("event_type").isin("celebration", "reaction"), F.lit(False))
    run = scan(seen.withColumn("_open", F.when(joins, 0).otherwise(1)), ["match_id"], ["slot"], block, upto={"section": ("sum", F.col("_open"))})
    text = F.array_sort(F.collect_list(F.struct("slot", F.trim("narration").alias("t"))))
    return run.groupBy("match_id", "section").agg(
        F.count(F.lit(1)).alias("scenes"), F.min("out_start_ms").alias("start_ms"), F.max_by("out_end_ms", "slot").alias("end_ms"), F.array_join(text["t"], " ").alias("narration"))


def locked_slots(moments: DataFrame, manifest: DataFrame, length: DataFrame, block: Column) -> DataFrame:
    """Slots of a locked edit per match, or the violation that forbids narration.

    Manifest rows of scenes that are not locked are left out. The rest must name every locked scene exactly once, lie
    within the edit, and not start before their predecessor in ``position`` (blocks of it bound a task).
    """
    scenes = moments.groupBy("match_id").agg(F.count("*").alias("scenes"), F.count_distinct(F.nullif("moment_id", F.lit(""))).alias("ids"))
    slots = manifest.join(moments.select("match_id", "moment_id").distinct(), ["match_id", "moment_id"], "left_semi").join(length, "match_id", "left")
    ordered = scan(slots, ["match_id"], ["position"], block, prior={"_prev": ("last", F.col("out_start_ms"))})
    start, end = F.col("out_start_ms"), F.col("out_end_ms")
    bad = start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > F.col("edit_ms") + 1) | (start < F.col("_prev"))
    found = ordered.groupBy("match_id").agg(F.count("*").alias("slots"), F.count_distinct("moment_id").alias("named"), F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias("bad"))
    rows = scenes.join(found, "match_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    disagree = (zero("slots") != F.col("scenes")) | (zero("named") != F.col("scenes")) | (zero("bad") > 0)
    return rows.select("match_id", "scenes", zero("slots").alias("slots"), F.when(F.col("ids") != F.col("scenes"), "ids_not_unique").when(disagree, "timing_disagrees").alias("violation"))


# Opening cues and payoff cues by event.
OPENING_CUES = {"goal": "THE DECISIVE TOUCH", "save": "QUICK REACTIONS", "big_chance": "A BIG CHANCE", "shot_on_target": "TESTING THE KEEPER"}
PAYOFF_CUES = {"goal": "WHAT A FINISH", "save": "DENIED BY THE KEEPER", "big_chance": "SO CLOSE", "shot_on_target": "ON TARGET"}


def sparse_cues(moments: DataFrame) -> DataFrame:
    """One opening cue, and a payoff cue when it comes late enough. Needs ``out_ms``, ``window_start_ms``, ``window_end_ms``."""
    own = concise(F.col("caption"))
    claims = own.rlike(r"\b(?:GOAL|FINISH|SCORES?|SCORED|SAVED|DENIED|TARGET)\b")
    text = F.when(claims, "WATCH THE BUILDUP").when(own != "", own).otherwise(S.lookup(OPENING_CUES, F.col("event_type"), "SPACE OPENS UP"))
    first_end = F.least(F.col("out_ms") - 100, 120 + F.least(F.lit(1_500), F.floor(F.col("out_ms") * 0.30)))
    pay = S.lookup(PAYOFF_CUES, F.col("event_type"))
    start = F.col("window_start_ms")
    ok = pay.isNotNull() & (start >= first_end + 300) & (start < F.col("out_ms") - 400)
    cue = lambda k, t, a, b: F.struct(F.lit(k).alias("cue"), t.alias("text"), a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    cues = F.array_compact(F.array(
        cue("opening", text, F.lit(120), first_end), F.when(ok, cue("payoff", pay, start, F.least(F.col("out_ms") - 80, F.col("window_end_ms"), start + 1_100)))))
    return moments.where(~S.reaction()).select("match_id", "moment_id", F.inline(cues))


# Fixed values.
OUTCOME_TEXT = {
    "goal": "The moving ball crosses the goal line inside the goal.", "keeper_save": "The goalkeeper visibly stops or deflects the shot.",
    "woodwork": "The ball strikes the goal frame and stays out.", "blocked": "The attempt is blocked and the ball stays out.",
    "wide": "The shot passes outside the goalpost.", "over": "The shot goes over the crossbar.",
}
OUTCOME_FACT = r"(?i)\b(goal|scores?|scored|saves?|saved|blocks?|blocked|net|crossbar|post|wide|over|stops?|deflects?)\b"


def reviewed_narration(rows: DataFrame) -> DataFrame:
    """Facts without outcome words, closed by the one sentence the review supports."""
    text = F.when(F.col("reviewed_event").isNotNull(), S.lookup(OUTCOME_TEXT, F.col("outcome_type")))
    facts = F.filter("facts", lambda f: ~f.rlike(OUTCOME_FACT))
    return rows.where(text.isNotNull()).select("match_id", "moment_id", F.array_join(F.concat(facts, F.array(text)), " | ").alias("facts"))


def cue_windows(moments: DataFrame) -> DataFrame:
    """Event cue on the retimed clock. Needs ``freeze_at_ms`` (output) and ``freeze_ms``."""
    late = F.col("event_type").isin("goal", "shot_on_target", "shot_off_target", "save", "big_chance")
    n = S.length_ms()
    at = F.when(late, F.coalesce(F.col("payoff_start_ms") - F.col("start_ms"), F.floor(n * 0.72))).otherwise(F.coalesce(F.col("annotation_ms") - F.col("start_ms"), F.floor(n * 0.12)))
    inside = F.least(F.greatest(F.lit(80), n - 80), F.greatest(F.lit(80), at))
    out = F.floor(inside / F.col("playback_rate"))
    shifted = F.when((F.col("freeze_ms") > 0) & (out >= F.col("freeze_at_ms")), out + F.col("freeze_ms")).otherwise(out)
    return moments.select("match_id", "moment_id", shifted.alias("cue_start_ms"), (shifted + F.when(F.col("event_type") == "goal", 1_250).otherwise(950)).alias("cue_end_ms"))


def retime_keyframes(keyframes: DataFrame, scenes: DataFrame) -> DataFrame:
    """Keyframes on the output clock: rate, a freeze hold with two anchor rows, and later rows shifted."""
    rows = keyframes.join(scenes, ["match_id", "scene_id"]).withColumn("o_ms", F.floor(F.col("t_ms") / F.col("rate")))
    held = F.col("hold_ms") > 0
    moved = rows.select("match_id", "scene_id", F.lit("frame").alias("kind"), "frame", (F.col("o_ms") + F.when(held & (F.col("o_ms") > F.col("hold_at_ms")), F.col("hold_ms")).otherwise(0)).alias("o_ms"), "camera_x")
    near = rows.where(held).groupBy("match_id", "scene_id", "hold_at_ms", "hold_ms").agg(
        F.min_by(F.struct("frame", "camera_x"), F.struct(F.abs(F.col("o_ms") - F.col("hold_at_ms")), "t_ms")).alias("a"))
    anchor = lambda kind, at: near.select("match_id", "scene_id", F.lit(kind).alias("kind"), "a.frame", at.alias("o_ms"), "a.camera_x")
    return moved.unionByName(anchor("hold_start", F.col("hold_at_ms"))).unionByName(anchor("hold_end", F.col("hold_at_ms") + F.col("hold_ms")))


def writer_packet(slots: DataFrame, observations: DataFrame, identities: DataFrame) -> DataFrame:
    """One row per slot: windows, word budget, identity and its distinct observations."""
    first = observations.groupBy("match_id", "moment_id", "phase", "o_ms", "text").agg(F.min("ordinal").alias("ordinal"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws("@", "phase", "text").alias("t"))))
    obs = first.groupBy("match_id", "moment_id").agg(F.array_join(listed["t"], "; ").alias("observations"))
    secs = (F.col("out_end_ms") - F.col("out_start_ms")) / 1000
    rows = slots.join(obs, ["match_id", "moment_id"], "left").join(identities, ["match_id", "story_id"], "left")
    return rows.select(
        "match_id", "moment_id", "story_id", "out_start_ms", "out_end_ms", F.greatest(F.lit(2), F.floor(secs * 2.6 * 0.9 + 1e-9)).alias("suggested"), "scorer",
        F.coalesce("observations", "claim").alias("evidence"))


def review_manifest(moments: DataFrame, identities: DataFrame, block: Column) -> DataFrame:
    """Ordered manifest of the edit: output clock, identity policy and overlay permissions."""
    from matchspark.operators.windows import output_clock

    clock = output_clock(moments, block)
    good = S.is_true("tracking_passed") | F.coalesce(F.lower("tracking_decision").rlike("pass|verified|^planned_reaction$"), F.lit(False))
    rows = moments.join(clock, ["match_id", "moment_id"]).join(identities, ["match_id", "story_id"], "left")
    return rows.select(
        "match_id", "slot", "moment_id", "out_start_ms", "out_end_ms", F.when(F.col("scorer").isNotNull(), "use_only_this_binding").otherwise("role_only_no_player_name").alias("identity_policy"),
        (good & ~F.col("event_type").isin("reaction", "celebration")).alias("player_ring"), (good & (F.col("effect") == "freeze_analysis")).alias("freeze"))
