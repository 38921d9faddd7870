"""Queries over request logs, job events and stored objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import telemetry as T
from matchspark.plans.registry import query

WORK_SQL = """CASE WHEN regexp_matches(label, 'hybrid crop outcome', 'i') THEN 'crop_finish' WHEN regexp_matches(label, 'hybrid rendered crop|visual keyframes|video keyframes', 'i') THEN 'crop_review'
  WHEN regexp_matches(label, 'semantic ball route', 'i') THEN 'source_action_guide' WHEN regexp_matches(label, 'narration|recap.*script|content draft', 'i') THEN 'script'
  WHEN regexp_matches(label, 'research|fixture|match context', 'i') THEN 'research' WHEN regexp_matches(label, 'initial|section|inventory|discovery', 'i') THEN 'source_discovery' ELSE 'other' END"""
C = lambda c: f"greatest(0, coalesce({c}, 0))"
SUM = lambda c: f"CAST(sum({C(c)}) AS BIGINT) AS {c}"


@query("workload_class", f"SELECT request_id, {WORK_SQL} AS workload FROM requests_v")
def _(v):
    return T.workload_class(v.requests).select("request_id", "workload")


@query("read_requests", "SELECT request_id, " + ", ".join(f"{C(c)} AS {c}" for c in T.COUNTERS) + " FROM requests_v")
def _(v):
    return T.read_requests(v.requests).select("request_id", *T.COUNTERS)


@query("request_stats", f"""SELECT job_id, {WORK_SQL} AS workload, count(*) AS attempts, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'capacity') AS capacity_errors,
   count(*) FILTER (status = 'timeout') AS timeout_errors, count(*) FILTER (status NOT IN ('success', 'capacity', 'timeout')) AS other_errors, {', '.join(SUM(c) for c in T.COUNTERS)},
   coalesce(array_to_string(list_sort(list_distinct(list(model))), ','), '') AS models FROM requests_v GROUP BY ALL""")
def _(v):
    return T.request_stats(v.requests)


@query("model_stats", f"""SELECT job_id, model, count(*) AS attempts, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'capacity') AS limited,
   count(*) FILTER (status = 'capacity' AND limit_kind = 'quota') AS quota_errors, count(*) FILTER (status = 'capacity' AND limit_kind = 'capacity') AS capacity_errors,
   count(*) FILTER (status = 'capacity' AND limit_kind IS NULL) AS unspecified, {', '.join(SUM(c) for c in T.COUNTERS[2:])} FROM requests_v WHERE model IS NOT NULL GROUP BY job_id, model""")
def _(v):
    return T.model_stats(v.requests)


@query("minute_buckets", f"""SELECT * FROM (SELECT job_id, model, us // 60000000 * 60000000 AS minute_us, count(*) AS requests, count(*) FILTER (status = 'capacity') AS limited, {', '.join(SUM(c) for c in T.COUNTERS[2:5])}
  FROM requests_v WHERE model IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY job_id, model ORDER BY minute_us DESC) <= 60""")
def _(v):
    return T.minute_buckets(v.requests, keep=60)


@query("phase_wall_time", """WITH n AS (SELECT *, lead(us) OVER w AS nu, lead(restarted) OVER w AS nr FROM job_events_v WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id))
  SELECT job_id, coalesce(phase, stage) AS phase, CAST(sum((nu - us) // 1000) AS BIGINT) AS wall_ms FROM n WHERE stage <> 'completed' AND nu IS NOT NULL AND NOT nr GROUP BY ALL""")
def _(v):
    return T.phase_wall_time(v.job_events, F.floor(F.col("us") / T.MINUTE_US))


ERR = """CASE k % 12 WHEN 0 THEN '{"error":{"code":429,"details":[{"@type":"type.x/google.rpc.QuotaFailure","violations":[{"subject":"a"},{"subject":"b"}]}]}}'
  WHEN 1 THEN '{"error":{"code":429,"details":[{"@type":"t/ErrorInfo","reason":"RATE_LIMIT_EXCEEDED","metadata":{"quota_metric":"rpm","quota_limit":"per minute!"}}]}}'
  WHEN 2 THEN '{"error":{"code":503,"details":[{"@type":"t/ErrorInfo","reason":"MODEL_CAPACITY"}]}}' WHEN 3 THEN 'ECONNRESET while reading' WHEN 4 THEN 'HTTP 499 client closed'
  WHEN 5 THEN 'Deadline exceeded for request' WHEN 6 THEN 'default credentials missing' WHEN 7 THEN 'No video stream found' WHEN 8 THEN 'keyframe coverage too low'
  WHEN 9 THEN 'status 503 temporarily unavailable' WHEN 10 THEN 'disk is odd' ELSE '{"error":{"code":429}}' END"""
ERRORS = ["concat('job-', CAST(user_id AS STRING)) AS job_id", "event_id", "us", f"{ERR} AS message",
          "CASE WHEN k % 17 = 0 THEN 403 WHEN k % 17 = 1 THEN 504 END AS status_code",
          "CASE k % 14 WHEN 0 THEN 'PROCESSOR_RESTART' WHEN 1 THEN 'INITIAL_FRAMING_PLAN' WHEN 2 THEN 'TTS_PERMISSION' WHEN 3 THEN 'EAI_AGAIN' WHEN 4 THEN 'SOURCE_VALIDATION' WHEN 5 THEN 'FIXED_SCENE_FRAMING_PENDING' END AS error_code",
          "k"]
ERRORS_SQL = f"err AS (SELECT {', '.join(ERRORS)} FROM base_v)"


@query("limit_kind", f"""WITH {ERRORS_SQL} SELECT event_id, coalesce(status_code, CASE k % 12 WHEN 0 THEN 429 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 11 THEN 429 END) AS http_status,
   CASE WHEN k % 12 IN (0, 1) THEN 'quota' WHEN k % 12 = 2 THEN 'capacity' ELSE 'unspecified' END AS kind, CASE k % 12 WHEN 1 THEN 'RATE_LIMIT_EXCEEDED' WHEN 2 THEN 'MODEL_CAPACITY' END AS reason,
   CASE WHEN k % 12 = 1 THEN 'rpm' END AS quota_metric, CAST(NULL AS VARCHAR) AS quota_limit, CASE WHEN k % 12 = 0 THEN 2 ELSE 0 END AS violations FROM err""")
def _(v):
    return T.limit_kind(v.base.selectExpr(*ERRORS)).select("event_id", "http_status", "kind", "reason", "quota_metric", "quota_limit", "violations")


@query("traffic_result", """SELECT request_id, tier, traffic_type, traffic_type = 'ON_DEMAND_PRIORITY' AS priority_verified, tier = 'priority' AND traffic_type = 'ON_DEMAND' AS downgraded
  FROM (SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'priority' ELSE 'standard' END AS tier, CASE request_id % 5 WHEN 0 THEN 'ON_DEMAND' WHEN 1 THEN 'ON_DEMAND_PRIORITY' WHEN 2 THEN 'ON_DEMAND' ELSE 'UNKNOWN' END AS traffic_type FROM requests_v)""")
def _(v):
    return T.traffic_result(v.requests.selectExpr("request_id", "CASE WHEN request_id % 2 = 0 THEN 'priority' ELSE 'standard' END AS tier",
        "CASE request_id % 5 WHEN 0 THEN 'ON_DEMAND' WHEN 1 THEN 'ON_DEMAND_PRIORITY' WHEN 2 THEN 'ON_DEMAND' END AS traffic_type"))


@query("model_provenance", """SELECT model AS requested_model, CASE WHEN request_id % 7 = 0 THEN 'backup' ELSE model END AS actual_model, count(*) AS responses, model <> CASE WHEN request_id % 7 = 0 THEN 'backup' ELSE model END AS switched
  FROM requests_v WHERE model IS NOT NULL GROUP BY ALL""")
def _(v):
    return T.model_provenance(v.requests.selectExpr("model AS requested_model", "CASE WHEN request_id % 7 = 0 THEN 'backup' ELSE model END AS actual_model"))


FAIL_SQL = """fail AS (SELECT *, coalesce(status_code, CASE WHEN regexp_matches(message, '\\b(408|499|500|502|503|504)\\b') THEN CAST(regexp_extract(message, '\\b(408|499|500|502|503|504)\\b', 1) AS BIGINT) END) AS st FROM err),
  fail2 AS (SELECT *, CASE WHEN st IN (400, 401, 403, 404, 422) THEN NULL WHEN st = 504 OR regexp_matches(message, 'deadline[_ ]exceeded', 'i') THEN 'timeout' WHEN st = 499 THEN 'cancelled'
    WHEN st IN (408, 500, 502, 503) OR regexp_matches(message, 'temporarily unavailable|ECONNRESET') OR error_code = 'EAI_AGAIN' THEN 'service' END AS failure FROM fail)"""


@query("service_failure", f"WITH {ERRORS_SQL}, {FAIL_SQL} SELECT event_id, CASE WHEN failure IS NOT NULL THEN st END AS failure_status, failure FROM fail2")
def _(v):
    return T.service_failure(v.base.selectExpr(*ERRORS)).select("event_id", "failure_status", "failure")


KIND_SQL = """kinds AS (SELECT *, CASE WHEN error_code = 'INITIAL_FRAMING_PLAN' THEN 'initial_plan' WHEN error_code = 'FIXED_SCENE_FRAMING_PENDING' THEN 'unchanged_framing'
   WHEN error_code = 'SOURCE_VALIDATION' OR k % 12 = 7 THEN 'source' WHEN error_code = 'TTS_PERMISSION' OR k % 12 = 6 THEN 'configuration'
   WHEN failure IS NOT NULL OR error_code IN ('PROCESSOR_RESTART', 'EAI_AGAIN') OR k % 12 IN (0, 1, 2, 3, 9, 11) OR (k % 12 = 5 AND false) THEN 'service'
   WHEN k % 12 = 8 THEN 'repair' ELSE 'technical' END AS kind FROM fail2)"""


@query("interruption_kind", f"WITH {ERRORS_SQL}, {FAIL_SQL}, {KIND_SQL} SELECT event_id, kind FROM kinds")
def _(v):
    return T.interruption_kind(v.base.selectExpr(*ERRORS)).select("event_id", "kind")


@query("recovery_state", f"""WITH {ERRORS_SQL}, {FAIL_SQL}, {KIND_SQL},
  a AS (SELECT *, row_number() OVER w AS attempt, CASE WHEN kind = lag(kind) OVER w AND us // 864000000000 = lag(us // 864000000000) OVER w THEN 0 ELSE 1 END AS turn FROM kinds WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id)),
  b AS (SELECT *, sum(turn) OVER (PARTITION BY job_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY job_id, g ORDER BY us, event_id) AS repeated FROM b),
  d AS (SELECT *, kind IN ('configuration', 'initial_plan', 'source_selection', 'unchanged_framing') OR (kind <> 'service' AND repeated >= 3) AS stuck FROM c)
  SELECT job_id, event_id, kind, attempt, repeated, CASE WHEN stuck THEN 'attention' ELSE 'waiting' END AS status,
    CASE WHEN NOT stuck THEN CASE WHEN error_code = 'PROCESSOR_RESTART' THEN 5000 ELSE least(180000, 5000 * CAST(pow(2, least(5, attempt - 1)) AS BIGINT)) END END AS delay_ms FROM d""")
def _(v):
    rows = T.interruption_kind(v.base.selectExpr(*ERRORS)).withColumn("signature", F.floor(F.col("us") / (10 * T.DAY_US)))
    return T.recovery_state(rows, F.floor(F.col("us") / T.MINUTE_US))


LINE = """CASE WHEN k % 6 = 0 THEN 'INFO noise' WHEN k % 6 = 1 THEN 'TRACK_PROGRESS not json' WHEN k % 6 = 2 THEN concat('TRACK_PROGRESS {"scene":"s', CAST(k % 4 AS STRING), '","completed":9,"total":0}')
  ELSE concat('TRACK_PROGRESS {"scene":"s', CAST(k % 4 AS STRING), '","completed":', CAST(k - 20 AS STRING), ',"total":60}') END AS line"""


@query("progress_events", """SELECT concat('job-', user_id) AS job_id, concat('s', k % 4) AS scene, arg_max(greatest(0e0, least(60, k - 20)), event_id)::DOUBLE AS completed, 60e0 AS total FROM base_v WHERE k % 6 > 2 GROUP BY ALL""")
def _(v):
    return T.progress_events(v.base.selectExpr("concat('job-', CAST(user_id AS STRING)) AS job_id", "event_id AS seq", LINE))


@query("merge_cooldowns", """SELECT model, max(us) AS retry_us FROM (SELECT kind AS model, us, k, event_id FROM base_v) WHERE k % 5 <> 0 AND k % 9 <> 1 GROUP BY model""")
def _(v):
    rows = v.base.selectExpr("kind AS model", "CASE WHEN k % 5 = 0 THEN 'other' ELSE kind END AS wait_model", "CASE WHEN k % 9 <> 1 THEN us END AS retry_us", "event_id")
    return T.merge_cooldowns(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


STATUS_PREV = ["concat('job-', CAST(event_id AS STRING)) AS job_id", "CASE k % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'tracking' ELSE 'rendering' END AS stage",
               "CASE WHEN k % 3 = 0 THEN 'boom' END AS error", "CASE WHEN k % 2 = 0 THEN 'halfway' END AS detail"]
STATUS_NEXT = ["concat('job-', CAST(event_id AS STRING)) AS job_id", "CASE k % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'tracking' WHEN 2 THEN 'completed' END AS n_stage",
               "CASE WHEN k % 8 = 0 THEN 'new boom' END AS n_error", "CASE WHEN k % 5 = 0 THEN 'fresh' END AS n_detail"]


@query("merge_status", f"""WITH p AS (SELECT {', '.join(STATUS_PREV)} FROM base_v), n AS (SELECT {', '.join(STATUS_NEXT)} FROM base_v WHERE event_id % 3 <> 0)
  SELECT job_id, coalesce(n_stage, stage) AS stage, CASE WHEN n_stage IS NULL OR n_stage = 'failed' OR n_error IS NOT NULL THEN coalesce(n_error, error) END AS error,
    CASE WHEN n_stage IS NULL OR n_stage = stage OR n_detail IS NOT NULL THEN coalesce(n_detail, detail) END AS detail FROM p LEFT JOIN n USING (job_id)""")
def _(v):
    return T.merge_status(v.base.selectExpr(*STATUS_PREV), v.base.where("event_id % 3 <> 0").selectExpr(*STATUS_NEXT))


NOW = 1_706_745_600_000_000
OBJECTS = ["event_id AS object_id", "concat(CASE k % 4 WHEN 0 THEN 'uploads/' WHEN 1 THEN 'outputs/' WHEN 2 THEN 'checkpoints/' ELSE 'jobs/' END, CAST(event_id AS STRING)) AS name", "us AS created_us",
           "CASE WHEN k % 3 = 0 THEN us + 86400000000 END AS custom_us"]


@query("expire_objects", f"""WITH o AS (SELECT {', '.join(OBJECTS)} FROM base_v)
  SELECT object_id, name FROM o WHERE (name LIKE 'uploads/%' AND ({NOW} - created_us >= 259200000000 OR {NOW} - custom_us >= 86400000000))
   OR (name LIKE 'outputs/%' AND ({NOW} - created_us >= 1209600000000 OR {NOW} - custom_us >= 604800000000)) OR (name LIKE 'checkpoints/%' AND {NOW} - created_us >= 259200000000)""")
def _(v):
    return T.expire_objects(v.base.selectExpr(*OBJECTS), NOW).select("object_id", "name")


RETAIN = ["concat('job-', CAST(event_id AS STRING)) AS job_id", "us AS created_us", "CASE WHEN k % 4 <> 0 THEN us + 1000 END AS updated_us", "CASE WHEN k % 3 = 1 THEN us + 5000 END AS completed_us",
          "CASE WHEN k % 5 = 2 THEN us + 9000 END AS published_us", "CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'completed' END AS stage"]


@query("retention_dates", f"""WITH j AS (SELECT {', '.join(RETAIN)} FROM base_v)
  SELECT job_id, coalesce(published_us + 86400000000, coalesce(completed_us, updated_us, created_us) + 1209600000000) AS source_delete_us,
   coalesce(published_us + 604800000000, coalesce(completed_us, updated_us, created_us) + 1209600000000) AS output_delete_us,
   stage = 'failed' AND coalesce(updated_us, created_us) + 259200000000 <= {NOW} AS expired FROM j""")
def _(v):
    return T.retention_dates(v.base.selectExpr(*RETAIN), NOW)


LIB = ["CASE k % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'uploaded' WHEN 3 THEN 'tracking' ELSE 'attention_required' END AS stage", "k % 2 = 0 AS ready",
       "concat('Match ', kind) AS source_name", "CASE WHEN k % 3 = 0 THEN 'Late CLICK drama' END AS title", "CAST(floor(value * 1000) AS BIGINT) AS bytes"]


@query("library_summary", f"""WITH j AS (SELECT {', '.join(LIB)} FROM base_v)
  SELECT count(*) AS projects, count(*) FILTER (stage = 'completed') AS completed, count(*) FILTER (stage IN ('failed', 'attention_required')) AS failed,
   count(*) FILTER (stage = 'tracking' OR (stage = 'uploaded' AND NOT ready)) AS working, CAST(sum(bytes) AS BIGINT) AS stored_bytes
  FROM j WHERE contains(lower(concat(source_name, ' ', coalesce(title, ''))), 'click')""")
def _(v):
    return T.library_summary(v.base.selectExpr(*LIB), "Click")
