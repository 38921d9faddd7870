"""Domain tables derived from the driver's parquet tables.

The derivations use integer arithmetic and the subset of SQL that Spark and
DuckDB share, so each list of expressions serves ``selectExpr`` here and the
oracle's CTE text. Nothing below is an operator; operators only see the result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators.timeline import scan

MATCH_MS = 5_400_000
SCENE_FRAMES = 32
PERIOD_SAMPLES = 512

# -- moments: one candidate interval per event -------------------------------

MOMENT_CLOCK = [
    "user_id AS match_id",
    "concat('m', CAST(event_id AS STRING)) AS moment_id",
    "event_id AS ordinal",
    "k",
    "value",
    "CAST(floor(us / 1000) AS BIGINT) % 5400000 AS start_ms",
    "CAST(floor(us / 1000) AS BIGINT) % 5400000 + 2000 + 1000 * (k % 20) AS end_ms",
    """CASE kind
         WHEN 'purchase' THEN CASE k % 4 WHEN 2 THEN 'disallowed_goal' WHEN 3 THEN 'celebration' ELSE 'goal' END
         WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'big_chance' WHEN 2 THEN 'var' ELSE 'offside' END
         WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'shot_on_target' WHEN 1 THEN 'shot_off_target' WHEN 2 THEN 'free_kick' ELSE 'assist' END
         WHEN 'view' THEN CASE k % 4 WHEN 2 THEN 'dribble' WHEN 3 THEN 'tackle' ELSE 'normal_play' END
         ELSE CASE k % 4 WHEN 0 THEN 'foul' WHEN 1 THEN 'yellow_card' WHEN 2 THEN 'penalty' ELSE 'skill' END
       END AS event_type""",
]
MOMENT_FIELDS = [
    "match_id", "moment_id", "ordinal", "start_ms", "end_ms", "event_type",
    "concat('s', CAST(CAST(floor(start_ms / 300000) AS BIGINT) AS STRING)) AS story_id",
    "CASE k % 7 WHEN 0 THEN 'build_up' WHEN 1 THEN 'reaction' WHEN 2 THEN 'replay' WHEN 3 THEN 'payoff' ELSE 'action' END AS story_phase",
    "CASE k % 9 WHEN 0 THEN 'reject' WHEN 1 THEN 'support' WHEN 2 THEN 'replay' ELSE 'keep' END AS keep_decision",
    "k % 5 = 0 AS is_replay",
    "CASE WHEN k % 3 = 0 THEN concat('d', CAST(CAST(floor(start_ms / 600000) AS BIGINT) AS STRING)) END AS duplicate_group",
    "CAST(CAST(floor(value) AS BIGINT) % 101 AS DOUBLE) AS importance",
    "(400 + 6 * k) / 1000e0 AS confidence",
    "CAST((ordinal * 7) % 101 AS DOUBLE) AS visual_clarity",
    "CAST((ordinal * 13) % 101 AS DOUBLE) AS completeness",
    "CASE k % 10 WHEN 8 THEN false WHEN 9 THEN NULL ELSE true END AS ball_visible",
    "CASE k % 11 WHEN 9 THEN false WHEN 10 THEN NULL ELSE true END AS player_visible",
    "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS semantic_verified",
    "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS action_complete",
    "CASE k % 4 WHEN 1 THEN true WHEN 2 THEN false END AS selection_locked",
    "k % 3 = 1 AS angle_selected",
    "k % 12 = 5 AS angle_deferred",
    "k % 13 = 7 AS support_deferred",
    "k % 2 = 1 AS additional_action",
    "k % 7 = 4 AS score_observation",
    "k % 14 = 3 AS view_split",
    "CASE k % 5 WHEN 1 THEN NULL WHEN 2 THEN false ELSE true END AS tracking_passed",
    "CASE k % 10 WHEN 0 THEN 'phase_verified_goal' WHEN 1 THEN 'semantic_mismatch' WHEN 2 THEN 'unstable_camera' WHEN 3 THEN 'hybrid_crop_verified' WHEN 4 THEN 'gemini_crop_verified' WHEN 5 THEN 'incomplete_goal_action' WHEN 6 THEN 'native_frame_verified_action' WHEN 7 THEN 'verified_decision_framing' END AS tracking_decision",
    "CASE k % 9 WHEN 0 THEN 'keyframe_contact_gap' WHEN 4 THEN 'duplicate' END AS reject_reason",
    "CASE k % 4 WHEN 0 THEN 0.72e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1.1e0 ELSE 0.85e0 END AS playback_rate",
    "CASE k % 6 WHEN 2 THEN 'freeze_analysis' WHEN 3 THEN 'slow_motion' WHEN 4 THEN 'replay_treatment' ELSE 'none' END AS effect",
    "CASE WHEN k % 6 = 2 THEN 400 + 10 * k ELSE 0 END AS freeze_ms",
    "CASE WHEN k % 3 = 1 THEN 200 ELSE 0 END AS transition_ms",
    "CASE WHEN k % 4 = 3 THEN NULL ELSE (ordinal * 11) % 97 END AS edit_order",
    "k % 3 <> 2 AS selected",
    "CASE WHEN k % 17 = 5 THEN start_ms + 600 * (2 + k % 20) ELSE start_ms + 60 * (2 + k % 20) END AS origin_ms",
    "CASE WHEN k % 17 = 3 THEN NULL ELSE start_ms + 340 * (2 + k % 20) END AS contact_ms",
    "CASE WHEN k % 19 = 4 THEN NULL ELSE start_ms + 380 * (2 + k % 20) END AS flight_ms",
    "CASE WHEN k % 2 = 0 THEN start_ms + 500 * (2 + k % 20) END AS handoff_ms",
    "start_ms + 680 * (2 + k % 20) AS payoff_start_ms",
    "start_ms + (CASE WHEN k % 23 = 6 THEN 500 ELSE 940 END) * (2 + k % 20) AS payoff_end_ms",
    "CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unclear' END AS attack_direction",
    "CASE k % 6 WHEN 0 THEN 'stable' WHEN 1 THEN 'joint_follow' WHEN 2 THEN 'ball_flight' WHEN 3 THEN 'goal_hold' WHEN 4 THEN 'reaction' ELSE 'drone' END AS camera_mode",
    "CASE WHEN k % 4 = 0 THEN NULL ELSE k / 64e0 END AS goal_focus_x",
    "CASE k % 5 WHEN 4 THEN false ELSE true END AS proof_verified",
    "CASE WHEN k % 10 = 7 THEN 'save' ELSE event_type END AS proof_event",
    "start_ms + 660 * (2 + k % 20) AS proof_start_ms",
    "start_ms + 1000 * (k % 20) + 1000 AS proof_end_ms",
    "(k % 80) / 128e0 AS box_x1",
    "(k % 40) / 128e0 AS box_y1",
    "(k % 80 + (k % 16) * 3) / 128e0 AS box_x2",
    "(k % 40 + 24) / 128e0 AS box_y2",
    "CASE k % 21 WHEN 13 THEN false WHEN 14 THEN true END AS crosscheck_verified",
    "CASE WHEN k % 4 = 1 THEN NULL ELSE concat('beat text ', CAST(k % 12 AS STRING)) END AS commentary",
    "concat('beat-', CAST(k % 15 AS STRING)) AS beat_id",
    "concat('scene ', CAST(k AS STRING), ' of ', event_type) AS description",
]

# -- reviews: a later observation of some moments ----------------------------

REVIEW_FIELDS = [
    "match_id", "moment_id", "ordinal", "start_ms AS source_start_ms", "end_ms AS source_end_ms",
    "CASE WHEN ordinal % 9 = 4 THEN 'save' WHEN ordinal % 9 = 5 THEN 'disallowed_goal' ELSE event_type END AS r_event_type",
    "CASE WHEN ordinal % 4 = 0 THEN NULL ELSE ordinal % 10 <> 3 END AS r_verified",
    "CASE WHEN ordinal % 5 = 0 THEN NULL ELSE ordinal % 7 <> 2 END AS r_complete",
    "ordinal % 6 = 2 AS r_is_replay",
    "CASE ordinal % 5 WHEN 1 THEN 'reaction' WHEN 2 THEN 'replay' WHEN 3 THEN NULL ELSE 'action' END AS r_phase",
    "CASE ordinal % 3 WHEN 0 THEN 18 WHEN 1 THEN 19 ELSE 20 END AS r_version",
    "start_ms + 100 * (ordinal % 12) AS w_start_ms",
    "end_ms - 100 * (ordinal % 9) AS w_end_ms",
    "start_ms - 500 + 200 * (ordinal % 4) AS w_review_start_ms",
    "end_ms + 300 - 100 * (ordinal % 8) AS w_review_end_ms",
    "ordinal % 11 <> 1 AS setup_visible",
    "ordinal % 13 <> 2 AS contact_visible",
    "ordinal % 17 <> 3 AS flight_visible",
    "ordinal % 19 <> 4 AS payoff_visible",
    "ordinal % 23 <> 5 AS clean_bounds",
    "340 * (ordinal % 24) AS rel_contact_ms",
    "CASE WHEN ordinal % 8 = 6 THEN NULL ELSE 400 * (ordinal % 24) END AS rel_flight_ms",
    "700 * (ordinal % 24) AS rel_payoff_start_ms",
    "950 * (ordinal % 24) AS rel_payoff_end_ms",
    "CASE ordinal % 6 WHEN 0 THEN 'goal' WHEN 1 THEN 'save' WHEN 2 THEN 'miss' WHEN 3 THEN 'block' WHEN 4 THEN 'woodwork' ELSE 'unclear' END AS outcome",
    "CASE WHEN ordinal % 9 = 7 THEN 'scene evidence mismatch' END AS r_reject_reason",
]

# -- frames and records: bounded scenes of 10 Hz samples ---------------------

FRAME_FIELDS = [
    "user_id AS match_id",
    "CAST(floor(n / 32) AS BIGINT) AS scene_id",
    "n % 32 AS frame",
    "100 * (n % 32) AS t_ms",
    "event_id AS ordinal",
    "k",
    "k % 25 = 0 AS cut",
    "kind <> 'error' AS direct",
    "CASE WHEN kind <> 'error' THEN (CAST(floor(value * 2) AS BIGINT) % 1000) / 1024e0 END AS ball_x",
    "CASE WHEN kind <> 'error' THEN k / 128e0 END AS ball_y",
    "((event_id * 37) % 100) / 128e0 AS ball_confidence",
    "CASE kind WHEN 'view' THEN 'setup' WHEN 'click' THEN 'contact' WHEN 'purchase' THEN 'flight' WHEN 'signup' THEN 'payoff' ELSE 'flight' END AS phase",
    "CASE WHEN k % 9 = 8 THEN NULL ELSE k % 4 END AS track_id",
    "CASE WHEN k % 9 = 8 THEN NULL ELSE ((event_id * 53) % 1000) / 1024e0 END AS px",
    "CASE WHEN k % 9 = 8 THEN NULL ELSE (200 + (event_id * 29) % 400) / 1024e0 END AS ptop",
    "CASE WHEN k % 9 = 8 THEN NULL ELSE (650 + (event_id * 31) % 300) / 1024e0 END AS pbottom",
    "((event_id * 41) % 100) / 128e0 AS subject_confidence",
    "k % 3 <> 1 AS joint_fit",
    "k % 4 < 2 AS possession",
    "((event_id * 17) % 800 + 100) / 1024e0 AS target_x",
    "((event_id * 19) % 400) / 1024e0 AS lo",
    "((event_id * 19) % 400 + 100 + (event_id * 23) % 500) / 1024e0 AS hi",
    "((event_id * 43) % 900 + 60) / 1024e0 AS camera_x",
    "k % 5 <> 2 AS ball_in_frame",
    "k % 6 <> 3 AS player_in_frame",
    "k % 8 <> 5 AS payoff_in_frame",
]

PLAYER_FIELDS = [
    "match_id", "scene_id", "frame", "t_ms", "ordinal", "k", "cut", "i AS idx",
    "CASE WHEN i = 4 THEN 'goalkeeper' WHEN (ordinal + i) % 13 = 0 THEN 'referee' ELSE 'player' END AS role",
    "(k + i) % 9 AS track_id",
    "(ordinal % 11) + i AS track_age",
    "((ordinal * 53 + i * 211) % 1000) / 1024e0 AS cx",
    "((ordinal * 61 + i * 167) % 700 + 150) / 1024e0 AS cy",
    "((ordinal * 53 + i * 211) % 1000 - 12 - i) / 1024e0 AS x1",
    "((ordinal * 53 + i * 211) % 1000 + 12 + i) / 1024e0 AS x2",
    "((ordinal * 61 + i * 167) % 700 + 90) / 1024e0 AS y1",
    "((ordinal * 61 + i * 167) % 700 + 210) / 1024e0 AS y2",
    "((ordinal * 7 + i * 31) % 100) / 128e0 AS confidence",
    "((ordinal * 3 + i * 17) % 100) / 128e0 AS pitch_support",
]

BALL_FIELDS = [
    "match_id", "scene_id", "frame", "t_ms", "ordinal", "k", "cut", "i AS idx",
    "((ordinal * 71 + i * 307) % 1000) / 1024e0 AS cx",
    "((ordinal * 83 + i * 131) % 1000) / 1024e0 AS cy",
    "((ordinal * 71 + i * 307) % 1000 - 3 - (ordinal + i) % 9) / 1024e0 AS x1",
    "((ordinal * 71 + i * 307) % 1000 + 3 + (ordinal + i) % 9) / 1024e0 AS x2",
    "((ordinal * 83 + i * 131) % 1000 - 5 - (ordinal + i) % 16) / 1024e0 AS y1",
    "((ordinal * 83 + i * 131) % 1000 + 5 + (ordinal + i) % 16) / 1024e0 AS y2",
    "((ordinal * 11 + i * 41) % 100) / 128e0 AS confidence",
    "((ordinal * 5 + i * 23) % 100) / 128e0 AS pitch_support",
]

# -- score samples: bounded periods of one sample per ten seconds ------------

SCORE_FIELDS = [
    "user_id * 1000 + CAST(floor(n / 512) AS BIGINT) AS match_id",
    "n % 512 + 1 AS sample_id",
    "10000 * (n % 512) AS t_ms",
    "kind <> 'error' AS readable",
    "greatest(0, up_home) AS home",
    "greatest(0, up_away) AS away",
    "CASE WHEN k % 11 = 6 THEN ' ' ELSE 'HOM' END AS home_label",
    "'AWY' AS away_label",
    """CASE WHEN k % 16 = 3 THEN '' WHEN k % 29 = 7 THEN '45:00 + 2:30'
            ELSE concat(CAST(CAST(floor((n % 512) / 6) AS BIGINT) + CASE WHEN k % 31 = 9 THEN 3 ELSE 0 END AS STRING), ':', CAST((n % 6) AS STRING), '0') END AS clock""",
]

# -- telemetry ---------------------------------------------------------------

REQUEST_FIELDS = [
    "concat('job-', CAST(user_id AS STRING)) AS job_id",
    "event_id AS request_id",
    """CASE k % 10 WHEN 0 THEN 'Hybrid crop outcome 3' WHEN 1 THEN 'visual keyframes batch' WHEN 2 THEN 'Semantic ball route'
         WHEN 3 THEN 'narration draft' WHEN 4 THEN 'Recap closing script' WHEN 5 THEN 'fixture lookup' WHEN 6 THEN 'Section inventory'
         WHEN 7 THEN 'hybrid rendered crop' WHEN 8 THEN 'match context' ELSE 'warmup' END AS label""",
    "CASE WHEN k % 13 = 0 THEN NULL ELSE kind END AS model",
    "CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'capacity' WHEN 2 THEN 'timeout' ELSE 'invalid' END AS status",
    "us",
    "CASE WHEN k % 7 = 2 THEN NULL ELSE k * 10 - 50 END AS gate_ms",
    "CAST(floor(value * 10) AS BIGINT) AS provider_ms",
    "CASE WHEN k % 5 = 1 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS prompt_tokens",
    "CASE WHEN k % 5 = 1 THEN NULL ELSE CAST(floor(value) AS BIGINT) - 3 END AS output_tokens",
    "k * 3 AS thinking_tokens",
    "CASE WHEN k % 2 = 0 THEN k END AS cached_tokens",
    "CASE k % 12 WHEN 1 THEN 'quota' WHEN 5 THEN 'capacity' END AS limit_kind",
]

JOB_EVENT_FIELDS = [
    "concat('job-', CAST(user_id AS STRING)) AS job_id",
    "event_id",
    "us",
    "CASE WHEN k % 20 = 19 THEN 'completed' WHEN kind = 'error' THEN 'failed' WHEN kind = 'view' THEN 'analyzing' WHEN kind = 'click' THEN 'tracking' ELSE 'rendering' END AS stage",
    "CASE WHEN k % 3 = 0 THEN NULL WHEN kind = 'view' THEN 'split' WHEN kind = 'click' THEN 'track' WHEN kind = 'purchase' THEN 'render' ELSE 'review' END AS phase",
    "k % 33 = 32 AS restarted",
]

# -- cuts, sections, masks, guides, beats ------------------------------------

MASK_FIELDS = [
    "match_id", "concat('mask', CAST(ordinal AS STRING)) AS mask_id",
    "start_ms + 1000 AS first_ms", "end_ms + 3000 AS last_ms",
    "((ordinal * 7) % 100) / 100e0 AS mask_confidence",
]

# -- score changes and earlier searches --------------------------------------

ANCHOR_FIELDS = [
    "match_id", "concat('anchor-', CAST(ordinal AS STRING)) AS anchor_id",
    "CASE WHEN ordinal % 2 = 0 THEN 'home' ELSE 'away' END AS side",
    "CASE WHEN ordinal % 6 = 5 THEN 'reversed' ELSE 'provisional' END AS status",
    "start_ms + 100 AS before_ms", "end_ms + 700 AS after_ms",
    "greatest(0, start_ms - 19900) AS search_start_ms", "least(5400000, end_ms + 20700) AS search_end_ms",
]
SEARCHED_FIELDS = [
    "match_id", "ordinal AS search_id", "greatest(0, start_ms - 40000) AS s_start_ms", "least(5400000, end_ms + 90000) AS s_end_ms",
]

BEAT_FIELDS = [
    "conv_id AS match_id", "concat('beat-', CAST(turn AS STRING)) AS beat_id", "turn AS ordinal",
    "role", "text AS narration",
]

BASE_SQL = """
  SELECT event_id, user_id, event_type AS kind, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         epoch_us(ts) AS us
  FROM events"""

_MOMENTS = ",\n    ".join(MOMENT_FIELDS)

#: CTE bodies for the oracle, in dependency order
VIEW_SQL: dict[str, str] = {
    "base_v": BASE_SQL,
    "clock_v": f"SELECT {', '.join(MOMENT_CLOCK)} FROM base_v",
    "moments_v": f"SELECT {_MOMENTS} FROM clock_v",
    "sources_v": "SELECT user_id AS match_id, CAST(5400000 AS BIGINT) AS duration_ms, 1920 AS width, 1080 AS height, 25e0 AS fps FROM events GROUP BY user_id",
    "reviews_v": f"SELECT {', '.join(REVIEW_FIELDS)} FROM moments_v WHERE ordinal % 3 <> 0",
    "cuts_v": """SELECT match_id, start_ms, lead(start_ms) OVER (PARTITION BY match_id ORDER BY start_ms) AS next_ms
      FROM (SELECT DISTINCT match_id, start_ms FROM moments_v)""",
    "shots_v": """SELECT match_id, start_ms AS shot_start_ms, coalesce(next_ms, CAST(5400000 AS BIGINT)) AS shot_end_ms,
      concat('shot-', CAST(start_ms AS STRING)) AS shot_id FROM cuts_v""",
    "numbered_v": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS n FROM base_v",
    "frames_v": f"SELECT {', '.join(FRAME_FIELDS)} FROM numbered_v",
    "players_v": f"SELECT {', '.join(PLAYER_FIELDS)} FROM frames_v, (SELECT unnest(range(5)) AS i)",
    "balls_v": f"SELECT {', '.join(BALL_FIELDS)} FROM frames_v, (SELECT unnest(range(3)) AS i)",
    "scored_v": """SELECT *, CAST(sum(CASE WHEN k < 8 THEN 1 WHEN k = 17 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS up_home,
      CAST(sum(CASE WHEN k BETWEEN 8 AND 15 THEN 1 WHEN k = 18 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS up_away
      FROM numbered_v WINDOW w AS (PARTITION BY user_id, n // 512 ORDER BY n ROWS UNBOUNDED PRECEDING)""",
    "score_samples_v": f"SELECT {', '.join(SCORE_FIELDS)} FROM scored_v",
    "requests_v": f"SELECT {', '.join(REQUEST_FIELDS)} FROM base_v",
    "job_events_v": f"SELECT {', '.join(JOB_EVENT_FIELDS)} FROM base_v",
    "masks_v": f"SELECT {', '.join(MASK_FIELDS)} FROM moments_v WHERE ordinal % 4 = 1",
    "anchors_v": f"SELECT {', '.join(ANCHOR_FIELDS)} FROM moments_v WHERE event_type IN ('goal', 'disallowed_goal') AND ordinal % 3 = 1",
    "searched_v": f"SELECT {', '.join(SEARCHED_FIELDS)} FROM moments_v WHERE ordinal % 4 = 2",
    "beats_v": f"SELECT {', '.join(BEAT_FIELDS)} FROM conversations",
}


class Tables:
    """Lazy access to the parquet tables and the derived domain tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        return self.parquet("events").selectExpr(
            "event_id", "user_id", "event_type AS kind", "value",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
            "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS us",
        )

    @cached_property
    def moments(self) -> DataFrame:
        return self.base.selectExpr(*MOMENT_CLOCK).selectExpr(*MOMENT_FIELDS)

    @cached_property
    def sources(self) -> DataFrame:
        return (
            self.parquet("events").select(F.col("user_id").alias("match_id")).distinct()
            .selectExpr("match_id", "CAST(5400000 AS BIGINT) AS duration_ms", "1920 AS width", "1080 AS height", "25e0 AS fps")
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.moments.where("ordinal % 3 <> 0").selectExpr(*REVIEW_FIELDS)

    @cached_property
    def shots(self) -> DataFrame:
        cuts = self.moments.select("match_id", "start_ms").distinct()
        block = F.floor(F.col("start_ms") / 10_000)
        nxt = scan(cuts, ["match_id"], ["start_ms"], block, after={"next_ms": ("min", F.col("start_ms"))})
        return nxt.selectExpr(
            "match_id", "start_ms AS shot_start_ms", "coalesce(next_ms, CAST(5400000 AS BIGINT)) AS shot_end_ms",
            "concat('shot-', CAST(start_ms AS STRING)) AS shot_id",
        )

    @cached_property
    def numbered(self) -> DataFrame:
        minute = F.floor(F.col("us") / 60_000_000)
        rows = scan(self.base, ["user_id"], ["us", "event_id"], minute, prior={"n": ("count", F.lit(1))})
        return rows.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.numbered.selectExpr(*FRAME_FIELDS)

    @cached_property
    def players(self) -> DataFrame:
        return self.frames.selectExpr("*", "explode(sequence(0L, 4L)) AS i").selectExpr(*PLAYER_FIELDS)

    @cached_property
    def balls(self) -> DataFrame:
        return self.frames.selectExpr("*", "explode(sequence(0L, 2L)) AS i").selectExpr(*BALL_FIELDS)

    @cached_property
    def score_samples(self) -> DataFrame:
        up = "CAST(sum(CASE WHEN {a} THEN 1 WHEN k = {b} THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, n div 512 ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT)"
        return self.numbered.selectExpr(
            "*", up.format(a="k < 8", b=17) + " AS up_home", up.format(a="k BETWEEN 8 AND 15", b=18) + " AS up_away"
        ).selectExpr(*SCORE_FIELDS)

    @cached_property
    def requests(self) -> DataFrame:
        return self.base.selectExpr(*REQUEST_FIELDS)

    @cached_property
    def job_events(self) -> DataFrame:
        return self.base.selectExpr(*JOB_EVENT_FIELDS)

    @cached_property
    def masks(self) -> DataFrame:
        return self.moments.where("ordinal % 4 = 1").selectExpr(*MASK_FIELDS)

    @cached_property
    def anchors(self) -> DataFrame:
        return self.moments.where("event_type IN ('goal', 'disallowed_goal') AND ordinal % 3 = 1").selectExpr(*ANCHOR_FIELDS)

    @cached_property
    def searched(self) -> DataFrame:
        return self.moments.where("ordinal % 4 = 2").selectExpr(*SEARCHED_FIELDS)

    @cached_property
    def beats(self) -> DataFrame:
        return self.parquet("conversations").selectExpr(*BEAT_FIELDS)
