"""Entity resolution: which observations are the same incident."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.scalar import SCORING, is_true, kept, not_false, reaction, replay, story
from matchspark.operators.linking import same_action_ok
from matchspark.operators.timeline import block_of, fold, interval_join
from matchspark.session import cut_lineage


def raw_scoring_obligations(drafts: DataFrame) -> DataFrame:
    """Scoring claims of a first response, kept before any validation, on the source clock."""
    ok = (
        F.col("event_type").isin(*SCORING) & ~F.col("story_phase").eqNullSafe(F.lit("reaction"))
        & F.col("event_type").eqNullSafe(F.col("outcome")) & is_true("result_seen")
    )
    key = F.substring(F.regexp_replace(F.coalesce("story_id", F.concat(F.lit("scene-"), F.col("ordinal").cast("string"))), "[^a-zA-Z0-9_-]", "-"), 1, 80)
    return drafts.where(ok).select(
        "match_id", "moment_id", F.concat_ws("-", F.lit("story"), F.floor(F.col("section_ms") / 1000 + 0.5).cast("string"), key).alias("story_id"), "event_type",
        *[(F.col(c) + F.col("section_ms")).alias(c) for c in ("start_ms", "end_ms", "contact_ms")], replay().alias("is_replay"),
    )


def incident_manifest(moments: DataFrame) -> DataFrame:
    """One row per incident and role: counts, time span and verified scenes.

    Members stay rows keyed by ``(match, story, role)``; no list of unbounded length is built.
    """
    role = F.when(reaction(), "reactions").when(replay(), "replays").otherwise("actions")
    return moments.groupBy("match_id", story().alias("story"), role.alias("role")).agg(
        F.count(F.lit(1)).alias("scenes"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.count(F.when(is_true("semantic_verified"), 1)).alias("verified"),
    )


def manifest_members(moments: DataFrame) -> DataFrame:
    role = F.when(reaction(), "reactions").when(replay(), "replays").otherwise("actions")
    return moments.select(
        "match_id", story().alias("story"), role.alias("role"), "moment_id", is_true("semantic_verified").alias("verified"),
        F.coalesce("tracking_decision", "keep_decision").alias("decision"), "reject_reason",
    )


def dedup_keyframes(keyframes: DataFrame) -> DataFrame:
    """Last finite row per scene and time."""
    cols = [c for c in keyframes.columns if c not in ("match_id", "scene_id", "t_ms")]
    best = keyframes.where("camera_x IS NOT NULL AND NOT isnan(camera_x)").groupBy("match_id", "scene_id", "t_ms").agg(F.max_by(F.struct(*cols), F.col("ordinal")).alias("_r"))
    return best.select("match_id", "scene_id", "t_ms", "_r.*")


def signature(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SHA-256 over the named columns in name order; nulls are left out."""
    return df.withColumn("signature", F.sha2(F.to_json(F.struct(*sorted(cols))), 256))


def reuse_split(df: DataFrame, saved: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose signature is saved, and rows that must be computed again."""
    signed = signature(df, cols)
    keys = saved.select("signature").distinct()
    return signed.join(keys, "signature", "left_semi"), signed.join(keys, "signature", "left_anti")


def dedup_sources(urls: DataFrame) -> DataFrame:
    """Distinct address, then the first per host domain (``www.`` ignored)."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    return urls.withColumn("host", host).where("host IS NOT NULL").groupBy("host").agg(F.min_by("url", "ordinal").alias("url"))


def compact_observations(obs: DataFrame) -> DataFrame:
    """Distinct (phase, time, text) per scene with its first position."""
    return obs.groupBy("match_id", "moment_id", "phase", "t_ms", "description").agg(F.min("ordinal").alias("ordinal"))


def needs_review(moments: DataFrame, model: str, version: int) -> DataFrame:
    """Moments whose last review is stale. Needs ``r_model``, ``r_version``, ``r_signature``, ``signature``, ``r_contract``."""
    stale = (
        ~F.col("r_model").eqNullSafe(F.lit(model))
        | ((F.col("event_type") == "celebration") & ~F.col("r_contract").eqNullSafe(F.lit(1)))
        | ~F.col("r_version").eqNullSafe(F.lit(version)) | ~F.col("r_signature").eqNullSafe(F.col("signature"))
    )
    return moments.where(stale)


def reuse_responses(saved: DataFrame, inputs: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Saved responses made for the same input under a known workload profile."""
    return saved.where(F.col("profile").isin(*profiles)).join(inputs.select("label", "input_key").distinct(), ["label", "input_key"], "left_semi")


def best_of_conflicts(
    rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], start: str, end: str, conflict, bin_ms: int = 60_000,
) -> DataFrame:
    """Greedy non-conflicting subset in rank order, without walking a key row by row.

    Equivalent to visiting the rows of a key by ``rank`` (distinct within a key) and keeping each that conflicts with no
    kept row, where only overlapping rows can conflict. The conflicts are found once, as edges from the better row to
    the worse. Each round keeps every row without a better one left and drops what those conflict with; rounds end when
    no edge is left, and their number is the longest chain of conflicts that depend on each other.
    ``conflict(a, b)`` gets two column getters.
    """
    cols = rows.columns
    body = [c for c in cols if c not in keys]
    clash = conflict(F.col, lambda c: F.col("o_" + c))
    ranked = cut_lineage(rows.withColumn("_rank", F.struct(*rank)))
    other = ranked.select(*keys, F.col("_rank").alias("o__rank"), *[F.col(c).alias("o_" + c) for c in body])
    near = interval_join(ranked, other, keys, (start, end), ("o_" + start, "o_" + end), bin_ms)
    edges = cut_lineage(near.where((F.col("o__rank") < F.col("_rank")) & clash).select(*keys, F.col("o__rank").alias("better"), F.col("_rank").alias("worse")))
    lost_parts = []
    while edges.limit(1).count():
        beaten = edges.select(*keys, F.col("worse").alias("better")).distinct()
        winners = edges.select(*keys, "better").distinct().join(beaten, [*keys, "better"], "left_anti")
        lost = cut_lineage(edges.join(winners, [*keys, "better"], "left_semi").select(*keys, "worse").distinct())
        lost_parts.append(lost)
        left = edges.join(lost, [*keys, "worse"], "left_anti").join(lost.withColumnRenamed("worse", "better"), [*keys, "better"], "left_anti")
        edges = cut_lineage(left)
    if lost_parts:
        lost = functools.reduce(DataFrame.unionByName, lost_parts)  # each row is lost once
        ranked = ranked.join(lost.withColumnRenamed("worse", "_rank"), [*keys, "_rank"], "left_anti")
    return ranked.select(*cols)


def unique_evidence(moments: DataFrame) -> DataFrame:
    """Ids of the moments left after interval suppression.

    Reviewed first, then not rejected, importance, length, input order. A row
    falls to a better one of its kind (reaction or not) showing the same action
    or overlapping 80 % of the shorter; reactions compare by their first 3 s.
    Invalid intervals always stay.
    """
    cut = F.when(reaction(), F.least("end_ms", F.col("start_ms") + 3_000)).otherwise(F.col("end_ms"))
    invalid = F.coalesce(cut <= F.col("start_ms"), F.lit(True))
    reviewed = is_true("semantic_verified") & not_false("action_complete") & kept()
    rows = moments.withColumns(
        dict(
            cut_ms=cut, react=reaction(), r1=F.when(reviewed, 0).otherwise(1), r2=F.when(F.col("semantic_verified").eqNullSafe(F.lit(False)), 1).otherwise(0),
            r3=-F.coalesce("importance", F.lit(0.0)), r4=F.col("start_ms") - F.col("end_ms"),
        )
    )
    valid = rows.where(~invalid)
    cols = ["match_id", "moment_id", "ordinal", "start_ms", "end_ms", "cut_ms", "react", "contact_ms", "proof_start_ms", "proof_end_ms", "r1", "r2", "r3", "r4"]
    base = valid.select(*cols, same_action_ok().alias("clocked"))

    def conflict(a, b):
        shared = F.least(a("cut_ms"), b("cut_ms")) - F.greatest(a("start_ms"), b("start_ms"))
        short = F.least(a("cut_ms") - a("start_ms"), b("cut_ms") - b("start_ms"))
        whole = F.least(a("end_ms"), b("end_ms")) - F.greatest(a("start_ms"), b("start_ms"))
        near = lambda c, ms: F.abs(a(c) - b(c)) <= ms
        same = (
            a("clocked") & b("clocked") & (whole >= F.least(a("end_ms") - a("start_ms"), b("end_ms") - b("start_ms")) * 0.35)
            & near("contact_ms", 350) & near("proof_start_ms", 500)
            & (F.least(a("proof_end_ms"), b("proof_end_ms")) >= F.greatest(a("proof_start_ms"), b("proof_start_ms")))
        )
        return F.coalesce(same, F.lit(False)) | (F.greatest(F.lit(0), shared) >= short * 0.8)

    best = best_of_conflicts(base, ["match_id", "react"], [F.col(c) for c in ("r1", "r2", "r3", "r4", "ordinal")], "start_ms", "end_ms", conflict)
    return best.select("match_id", "moment_id").unionByName(rows.where(invalid).select("match_id", "moment_id"))


def box_nms(detections: DataFrame, iou: float = 0.5) -> DataFrame:
    """Per frame and class, keep boxes by score unless they overlap a kept one.

    A frame holds a bounded number of detections, so the fold per frame is small.
    """
    row = F.struct((-F.col("confidence")).alias("s"), "idx", "x1", "y1", "x2", "y2")
    schema = "array<struct<s:double,idx:bigint,x1:double,y1:double,x2:double,y2:double>>"

    def step(acc, r):
        def hit(k):
            w = F.greatest(F.lit(0.0), F.least(k["x2"], r["x2"]) - F.greatest(k["x1"], r["x1"]))
            h = F.greatest(F.lit(0.0), F.least(k["y2"], r["y2"]) - F.greatest(k["y1"], r["y1"]))
            area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
            return w * h / F.greatest(F.lit(1e-9), area(k) + area(r) - w * h) > iou

        return F.when(F.exists(acc, hit), acc).otherwise(F.concat(acc, F.array(r)))

    keys = ["match_id", "scene_id", "frame", "role"]
    kept_rows = fold(detections, keys, row, F.array().cast(schema), step, "k")
    return kept_rows.select(*keys, F.explode("k.idx").alias("idx"))
