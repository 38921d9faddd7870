"""Request and job telemetry in batch form. The stream forms reuse these functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.timeline import scan

MINUTE_US = 60_000_000

# Label patterns of each workload, first match wins.
WORKLOAD_PATTERNS = [
    ("crop_finish", r"hybrid crop outcome"),
    ("crop_review", r"hybrid rendered crop|visual keyframes|video keyframes"),
    ("source_action_guide", r"Semantic ball route"),
    ("script", r"narration|recap.*script|content draft"),
    ("research", r"research|fixture|match context"),
    ("source_discovery", r"initial|section|inventory|discovery"),
]


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Name of the first case-insensitive pattern found in ``text``."""
    out = F.when(text.rlike("(?i)" + rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(text.rlike("(?i)" + pattern), name)
    return out.otherwise(default)


def workload_class(requests: DataFrame) -> DataFrame:
    return requests.withColumn("workload", first_match(F.coalesce("label", F.lit("")), WORKLOAD_PATTERNS, "other"))


COUNTERS = ["gate_ms", "provider_ms", "prompt_tokens", "output_tokens", "thinking_tokens", "cached_tokens"]


def read_requests(raw: DataFrame) -> DataFrame:
    """Request rows with missing counters as zero and negatives clamped."""
    return raw.withColumns({c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("long") for c in COUNTERS})


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def request_stats(requests: DataFrame) -> DataFrame:
    """Attempts, outcomes, waits and tokens per job and workload.

    ``models`` lists the few distinct model names; they are made distinct before
    they are collected, so the list is bounded by the model vocabulary.
    """
    rows = workload_class(read_requests(requests))
    known = F.col("status").isin("success", "capacity", "timeout")
    by_model = rows.groupBy("job_id", "workload", "model").agg(
        F.count(F.lit(1)).alias("attempts"), _n(F.col("status") == "success").alias("succeeded"),
        _n(F.col("status") == "capacity").alias("capacity_errors"), _n(F.col("status") == "timeout").alias("timeout_errors"),
        _n(~known).alias("other_errors"), *[F.sum(c).alias(c) for c in COUNTERS],
    )
    sums = ["attempts", "succeeded", "capacity_errors", "timeout_errors", "other_errors", *COUNTERS]
    return by_model.groupBy("job_id", "workload").agg(
        *[F.sum(c).alias(c) for c in sums], F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models")
    )


def model_stats(requests: DataFrame) -> DataFrame:
    """Per job and model: outcome split, kind of each limit, tokens."""
    limited = F.col("status") == "capacity"
    return read_requests(requests).where("model IS NOT NULL").groupBy("job_id", "model").agg(
        F.count(F.lit(1)).alias("attempts"), _n(F.col("status") == "success").alias("succeeded"), _n(limited).alias("limited"),
        _n(limited & (F.col("limit_kind") == "quota")).alias("quota_errors"),
        _n(limited & (F.col("limit_kind") == "capacity")).alias("capacity_errors"),
        _n(limited & ~F.coalesce(F.col("limit_kind").isin("quota", "capacity"), F.lit(False))).alias("unspecified"),
        *[F.sum(c).alias(c) for c in COUNTERS[2:]],
    )


def minute_buckets(requests: DataFrame, keep: int = 60) -> DataFrame:
    """Per job and model, the newest ``keep`` one-minute buckets by provider start."""
    minute = F.floor(F.col("us") / MINUTE_US) * MINUTE_US
    buckets = read_requests(requests).where("model IS NOT NULL").groupBy("job_id", "model", minute.alias("minute_us")).agg(
        F.count(F.lit(1)).alias("requests"), _n(F.col("status") == "capacity").alias("limited"),
        *[F.sum(c).alias(c) for c in COUNTERS[2:5]],
    )
    newest = Window.partitionBy("job_id", "model").orderBy(F.desc("minute_us"))
    return buckets.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep).drop("_rn")


def phase_wall_time(events: DataFrame, block: Column) -> DataFrame:
    """Wall time of each phase: the gap to the next event belongs to the earlier phase.

    A completed event starts nothing, and the gap before a restart is not counted.
    """
    rows = scan(events, ["job_id"], ["us", "event_id"], block, after={
        "next_us": ("first", F.col("us")), "next_restarted": ("first", F.col("restarted"))})
    live = rows.where((F.col("stage") != "completed") & F.col("next_us").isNotNull() & ~F.col("next_restarted"))
    return live.groupBy("job_id", F.coalesce("phase", "stage").alias("phase")).agg(
        F.sum(F.floor((F.col("next_us") - F.col("us")) / 1000)).alias("wall_ms")
    )


LIMIT_SCHEMA = """error STRUCT<code: BIGINT, details: ARRAY<STRUCT<`@type`: STRING, reason: STRING,
  violations: ARRAY<STRUCT<subject: STRING>>, metadata: STRUCT<quota_metric: STRING, quota_limit: STRING>>>>"""


def limit_kind(errors: DataFrame) -> DataFrame:
    """Classify a provider error body as quota, capacity or unspecified; keep safe identifiers only."""
    body = F.from_json("message", LIMIT_SCHEMA)["error"]
    details = F.coalesce(body["details"], F.array().cast("array<struct<`@type`:string,reason:string,violations:array<struct<subject:string>>,metadata:struct<quota_metric:string,quota_limit:string>>>"))
    pick = lambda suffix: F.try_element_at(F.filter(details, lambda d: d["@type"].endswith(suffix)), F.lit(1))
    safe = lambda c: F.when(c.rlike(r"^[a-zA-Z0-9_.:/{}-]{1,200}$"), c)
    quota, info = pick("QuotaFailure"), pick("ErrorInfo")
    reason = safe(info["reason"])
    metric, limit = safe(info["metadata"]["quota_metric"]), safe(info["metadata"]["quota_limit"])
    is_quota = quota.isNotNull() | metric.isNotNull() | limit.isNotNull() | F.coalesce(reason.rlike("QUOTA|RATE_LIMIT|SPEND_LIMIT"), F.lit(False))
    is_busy = F.coalesce(reason.rlike("CAPACITY|SERVER_OVERLOADED"), F.lit(False))
    return errors.withColumns(
        dict(
            http_status=F.coalesce("status_code", body["code"]),
            kind=F.when(is_quota, "quota").when(is_busy, "capacity").otherwise("unspecified"),
            reason=reason, quota_metric=metric, quota_limit=limit,
            violations=F.coalesce(F.size(quota["violations"]), F.lit(0)),
        )
    )


def traffic_result(responses: DataFrame) -> DataFrame:
    """Whether the requested tier was granted or downgraded."""
    kind = F.coalesce("traffic_type", F.lit("UNKNOWN"))
    return responses.withColumns(
        dict(traffic_type=kind, priority_verified=kind == "ON_DEMAND_PRIORITY",
             downgraded=(F.col("tier") == "priority") & (kind == "ON_DEMAND"))
    )


def model_provenance(responses: DataFrame) -> DataFrame:
    """Switch rate per requested and actual model."""
    return responses.where("requested_model IS NOT NULL AND actual_model IS NOT NULL").groupBy("requested_model", "actual_model").agg(
        F.count(F.lit(1)).alias("responses"), (F.first("requested_model") != F.first("actual_model")).alias("switched")
    )


def service_failure(errors: DataFrame) -> DataFrame:
    """timeout, cancelled or service for an unhealthy provider; null when not retryable."""
    msg = F.coalesce("message", F.lit(""))
    text_code = F.regexp_extract(msg, r"\b(408|499|500|502|503|504)\b", 1).try_cast("long")
    status = F.coalesce(F.when(F.col("status_code") != 0, F.col("status_code")), text_code)
    deadline = (status == 504) | msg.rlike("(?i)deadline[_ ]exceeded|deadline expired")
    deadline = F.coalesce(deadline, F.lit(False))
    unhealthy = (
        deadline | F.coalesce(status.isin(408, 499, 500, 502, 503), F.lit(False))
        | msg.rlike(r"(?i)temporarily unavailable|internal(?: server)? error|socket hang up|ECONNRESET|ETIMEDOUT|fetch failed")
        | F.coalesce("error_code", F.lit("")).rlike("(?i)ECONNRESET|ETIMEDOUT|EAI_AGAIN")
    )
    client = F.coalesce(status.isin(400, 401, 403, 404, 422), F.lit(False))
    kind = F.when(client | ~unhealthy, None).when(deadline, "timeout").when(status == 499, "cancelled").otherwise("service")
    return errors.withColumn("failure_status", F.when(kind.isNotNull(), status)).withColumn("failure", kind)


# Patterns of the interruption classes.
SOURCE_TEXT = r"No video stream|Could not read the video duration|uploaded video was empty|saved source video is missing"
CONFIG_TEXT = (
    r"permission.?denied|unauthenticated|invalid api key|default credentials|not configured|(?:API key|credentials) (?:is|are) required"
    r"|must be google_cloud|spawn .+ ENOENT|Unrecognized option|Unknown (?:filter|encoder)"
)
SERVICE_TEXT = (
    r"429|RESOURCE_EXHAUSTED|504|503|502|ETIMEDOUT|ECONNRESET|fetch failed|temporarily unavailable"
    r"|(?:Gemini|Google|TTS|request).*(?:timed out|timeout|deadline exceeded)"
)
REPAIR_TEXT = r"framing|tracking|keyframe|verified|coverage|scene|semantic|narration|script|JSON|duration|alignment|synchronization|loudness"


def interruption_kind(errors: DataFrame) -> DataFrame:
    """Eight-way class of a processing interruption."""
    rows = service_failure(errors)
    msg, code = F.coalesce("message", F.lit("")), F.coalesce("error_code", F.lit(""))
    has = lambda p: msg.rlike("(?i)" + p)
    kind = (
        F.when(code == "INITIAL_FRAMING_PLAN", "initial_plan").when(code == "SOURCE_SELECTION_CONFLICT", "source_selection")
        .when(code == "FIXED_SCENE_FRAMING_PENDING", "unchanged_framing").when((code == "SOURCE_VALIDATION") | has(SOURCE_TEXT), "source")
        .when(code.rlike("TTS_CONFIGURATION|TTS_AUTHENTICATION|TTS_PERMISSION") | has(CONFIG_TEXT), "configuration")
        .when(
            F.col("failure").isNotNull() | code.isin("TTS_TRANSIENT", "PROCESSOR_RESTART")
            | code.rlike("ETIMEDOUT|ECONNRESET|EAI_AGAIN") | has(SERVICE_TEXT), "service")
        .when(has(REPAIR_TEXT), "repair").otherwise("technical")
    )
    return rows.withColumn("kind", kind)


def recovery_state(interruptions: DataFrame, block: Column) -> DataFrame:
    """Attempt and repeat counters, attention flag and retry delay per interruption.

    The repeat counter restarts whenever the kind or the progress signature
    differs from the previous interruption, so a run is the distance to its
    latest change.
    """
    order = ["us", "event_id"]
    seen = scan(interruptions, ["job_id"], order, block, prior={
        "_kind": ("last", F.col("kind")), "_sig": ("last", F.col("signature"))}, upto={"attempt": ("count", F.lit(1))})
    turn = F.when(F.col("_kind").eqNullSafe(F.col("kind")) & F.col("_sig").eqNullSafe(F.col("signature")), None).otherwise(F.col("attempt"))
    run = scan(seen.withColumn("_turn", turn), ["job_id"], order, block, upto={"_open": ("max", F.col("_turn"))})
    repeated = F.col("attempt") - F.col("_open") + 1
    stuck = F.col("kind").isin("configuration", "initial_plan", "source_selection", "unchanged_framing") | ((F.col("kind") != "service") & (repeated >= 3))
    delay = F.least(F.lit(180_000), F.lit(5_000) * F.pow(F.lit(2), F.least(F.lit(5), F.col("attempt") - 1)).cast("long"))
    delay = F.when(F.col("error_code") == "PROCESSOR_RESTART", 5_000).otherwise(delay)
    return run.select(
        "job_id", "event_id", "kind", "attempt", repeated.alias("repeated"), F.when(stuck, "attention").otherwise("waiting").alias("status"),
        F.when(~stuck, delay).alias("delay_ms"),
    )


def progress_events(lines: DataFrame) -> DataFrame:
    """Valid progress lines, clamped, reduced to the latest per scene."""
    body = F.when(F.col("line").startswith("TRACK_PROGRESS "), F.from_json(F.expr("substring(line, 16)"), "scene STRING, completed DOUBLE, total DOUBLE"))
    rows = lines.withColumn("p", body).where("p.completed IS NOT NULL AND p.total >= 1")
    return rows.groupBy("job_id", F.col("p.scene").alias("scene")).agg(
        F.max_by(F.struct(F.greatest(F.lit(0.0), F.least("p.total", "p.completed")).alias("completed"), F.col("p.total").alias("total")), F.col("seq")).alias("l")
    ).select("job_id", "scene", "l.completed", "l.total")


def merge_cooldowns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Latest valid retry time per model over both sources."""
    rows = a.unionByName(b).where("retry_us IS NOT NULL AND model = wait_model")
    return rows.groupBy("model").agg(F.max("retry_us").alias("retry_us"))


def merge_status(prev: DataFrame, nxt: DataFrame) -> DataFrame:
    """Overlay an incoming job snapshot; clear a stale error or detail."""
    rows = prev.join(nxt, "job_id", "left")
    err = F.when(F.col("n_stage").isNotNull() & (F.col("n_stage") != "failed") & F.col("n_error").isNull(), None).otherwise(F.coalesce("n_error", "error"))
    detail = F.when(
        F.col("n_stage").isNotNull() & ~F.col("n_stage").eqNullSafe(F.col("stage")) & F.col("n_detail").isNull(), None
    ).otherwise(F.coalesce("n_detail", "detail"))
    return rows.select("job_id", F.coalesce("n_stage", "stage").alias("stage"), err.alias("error"), detail.alias("detail"))


DAY_US = 86_400_000_000

# Retention rules as (prefix, days of age).
RETENTION_RULES = [("uploads/", 3), ("outputs/", 14), ("checkpoints/", 3)]
# Retention rules as (prefix, days since the custom time).
CUSTOM_RULES = [("uploads/", 1), ("outputs/", 7)]


def expire_objects(objects: DataFrame, now_us: int) -> DataFrame:
    """Stored objects whose prefix rule has run out, by age or by custom time."""
    due = F.lit(False)
    for prefix, days in RETENTION_RULES:
        due = due | (F.col("name").startswith(prefix) & (F.lit(now_us) - F.col("created_us") >= days * DAY_US))
    for prefix, days in CUSTOM_RULES:
        due = due | (F.col("name").startswith(prefix) & F.coalesce(F.lit(now_us) - F.col("custom_us") >= days * DAY_US, F.lit(False)))
    return objects.where(due)


def retention_dates(jobs: DataFrame, now_us: int) -> DataFrame:
    """When a job's source and output may be deleted, and whether a failed job has expired."""
    updated = F.coalesce("updated_us", "created_us")
    done = F.coalesce("completed_us", "updated_us", "created_us")
    at = lambda days: F.when(F.col("published_us").isNotNull(), F.col("published_us") + days * DAY_US).otherwise(done + 14 * DAY_US)
    return jobs.select(
        "job_id", at(1).alias("source_delete_us"), at(7).alias("output_delete_us"),
        ((F.col("stage") == "failed") & (updated + 3 * DAY_US <= now_us)).alias("expired"),
    )


def library_summary(jobs: DataFrame, text: str) -> DataFrame:
    """Counts by stage group and stored bytes over the jobs matching a text search."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("source_name", F.lit("")), F.coalesce("title", F.lit(""))))
    stopped = F.col("stage").isin("completed", "failed", "attention_required")
    return jobs.where(F.contains(hay, F.lit(text.lower()))).agg(
        F.count(F.lit(1)).alias("projects"), _n(F.col("stage") == "completed").alias("completed"),
        _n(F.col("stage").isin("failed", "attention_required")).alias("failed"),
        _n(~stopped & ~((F.col("stage") == "uploaded") & F.coalesce("ready", F.lit(False)))).alias("working"),
        F.sum("bytes").alias("stored_bytes"),
    )
