"""Column expressions: no row-level Python, everything stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Editorial weight of each event type.
EVENT_WEIGHTS = {
    "goal": 100,
    "disallowed_goal": 92,
    "offside": 63,
    "penalty": 95,
    "save": 90,
    "big_chance": 85,
    "assist": 85,
    "shot_on_target": 82,
    "shot_off_target": 72,
    "free_kick": 80,
    "var": 76,
    "foul": 55,
    "yellow_card": 60,
    "red_card": 84,
    "skill": 70,
    "dribble": 70,
    "tackle": 65,
    "celebration": 50,
    "normal_play": 15,
}

# Priority of an incident by its event type.
INCIDENT_PRIORITY = {
    "goal": 1000,
    "disallowed_goal": 950,
    "offside": 850,
    "var": 850,
    "save": 700,
    "shot_on_target": 700,
    "big_chance": 500,
    "free_kick": 400,
}

# Event families.
SCORING = ["goal", "disallowed_goal"]
DECISIONS = ["var", "offside", "disallowed_goal"]
SHOTS = ["goal", "disallowed_goal", "save", "shot_on_target", "shot_off_target", "big_chance"]


def half_up(c: Column) -> Column:
    """Round to the nearest integer, halves up."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def lookup(table: dict, key: Column, default=None) -> Column:
    """Constant-folded map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def is_true(c: str | Column) -> Column:
    """Only an explicit true."""
    return (F.col(c) if isinstance(c, str) else c).eqNullSafe(F.lit(True))


def not_false(c: str | Column) -> Column:
    """True or unknown."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(True))


def replay() -> Column:
    return is_true("is_replay") | F.coalesce(F.col("story_phase") == "replay", F.lit(False))


def reaction() -> Column:
    return (F.col("event_type") == "celebration") | F.coalesce(F.col("story_phase") == "reaction", F.lit(False))


def kept() -> Column:
    return F.coalesce(F.col("keep_decision") != "reject", F.lit(True))


def story() -> Column:
    return F.coalesce("story_id", "moment_id")


def deferred() -> Column:
    return is_true("angle_deferred") | is_true("support_deferred")


def length_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def overlap(a_start, a_end, b_start, b_end) -> Column:
    return F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start))


def normalize_score_scale(value: Column, fallback: float = 0.0) -> Column:
    """Parse a 0-10 or 0-100 rating into 0..100; blank text counts as zero."""
    blank = F.trim(value.cast("string")) == ""
    parsed = F.when(blank, F.lit(0.0)).otherwise(value.try_cast("double"))
    finite = F.when(F.isnan(parsed) | (F.abs(parsed) == float("inf")), None).otherwise(parsed)
    score = F.coalesce(finite, F.lit(float(fallback)))
    scaled = F.when((score > 0) & (score <= 10), score * 10).otherwise(score)
    return half_up(clamp(scaled, 0.0, 100.0))


CLOCK_PATTERN = r"^(\d{1,3}):(\d{2})(?:\s*\+\s*(\d{1,2})(?::(\d{2}))?)?$"


def match_clock_seconds(clock: Column) -> Column:
    """``mm:ss`` with optional ``+ a:b`` stoppage, in seconds; null when malformed."""
    part = lambda i: F.coalesce(F.regexp_extract(clock, CLOCK_PATTERN, i).try_cast("long"), F.lit(0))
    return F.when(clock.rlike(CLOCK_PATTERN), part(1) * 60 + part(2) + part(3) * 60 + part(4))


def candidate_state() -> Column:
    """rejected, verified or pending, reading each flag as a tri-state."""
    gone = ~kept() | F.coalesce(~F.col("semantic_verified"), F.lit(False))
    proved = (
        is_true("semantic_verified") & not_false("action_complete") & ~deferred() & not_false("crosscheck_verified")
    )
    return F.when(gone, "rejected").when(proved, "verified").otherwise("pending")


def coverage_state_sql() -> str:
    """The same three states as SQL text, for the oracles."""
    return """CASE WHEN keep_decision = 'reject' OR semantic_verified IS FALSE THEN 'rejected'
      WHEN semantic_verified AND action_complete IS NOT FALSE AND NOT angle_deferred AND NOT support_deferred
        AND crosscheck_verified IS NOT FALSE THEN 'verified' ELSE 'pending' END"""
