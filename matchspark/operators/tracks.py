"""Track time series of one scene at a time.

Scenes are short clips, so a window per ``(match_id, scene_id)`` or per shot
inside it sorts a bounded number of rows; a long match spreads over its scenes.
A cut row belongs to the shot it opens.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators.scenes import beam_search, carriers, control_points, in_groups, tracks, tripod
from matchspark.operators.timeline import fold

SCENE = ["match_id", "scene_id"]
SHOT = [*SCENE, "shot"]


def r5(c: Column | str) -> Column:
    """Five decimals; the nudge keeps exact ties from depending on float noise."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 5)


def by_time(keys=SCENE):
    return Window.partitionBy(*keys).orderBy("t_ms")


def before(keys=SCENE):
    return by_time(keys).rowsBetween(Window.unboundedPreceding, -1)


def after(keys=SCENE):
    return by_time(keys).rowsBetween(1, Window.unboundedFollowing)


def with_shot(frames: DataFrame) -> DataFrame:
    """Add ``shot``: the number of cuts up to and including the row."""
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("shot", F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(upto))


def _ends(frames: DataFrame) -> DataFrame:
    """Nearest observed ball before and after each row of its shot."""
    rows = with_shot(frames)
    hit = F.when(F.col("ball_x").isNotNull(), F.struct("t_ms", "ball_x", "ball_y"))
    return rows.withColumns(dict(
        p=F.last(hit, ignorenulls=True).over(before(SHOT)), q=F.first(hit, ignorenulls=True).over(after(SHOT))))


def _between() -> tuple[Column, Column]:
    a = (F.col("t_ms") - F.col("p.t_ms")) / (F.col("q.t_ms") - F.col("p.t_ms"))
    return F.col("p.ball_x") * (1 - a) + F.col("q.ball_x") * a, F.col("p.ball_y") * (1 - a) + F.col("q.ball_y") * a


def fill_gaps(frames: DataFrame, max_gap_ms: int = 450) -> DataFrame:
    """Interpolated ball positions between two observations of one shot; never marked direct."""
    x, y = _between()
    rows = _ends(frames).where(F.col("ball_x").isNull() & (F.col("q.t_ms") - F.col("p.t_ms") <= max_gap_ms))
    return rows.select(*SCENE, "frame", r5(x).alias("guide_x"), r5(y).alias("guide_y"))


def guidance(frames: DataFrame, max_gap_ms: int = 750, closing_ms: int = 550, opening_ms: int = 3_000) -> DataFrame:
    """Gap filling plus a hold of the first and last observation at the shot's edges."""
    x, y = _between()
    rows = _ends(frames).where("ball_x IS NULL")
    inner = F.col("q.t_ms") - F.col("p.t_ms") <= max_gap_ms
    head = F.col("p").isNull() & (F.col("q.t_ms") - F.col("t_ms") <= opening_ms)
    tail = F.col("q").isNull() & (F.col("t_ms") - F.col("p.t_ms") <= closing_ms)
    pick = lambda mid, c: F.when(inner, mid).when(head, F.col(f"q.{c}")).when(tail, F.col(f"p.{c}"))
    out = rows.select(*SCENE, "frame", r5(pick(x, "ball_x")).alias("guide_x"), r5(pick(y, "ball_y")).alias("guide_y"))
    return out.where("guide_x IS NOT NULL")


def origin_lock(records: DataFrame, reach: float = 0.13) -> DataFrame:
    """First subject holding the ball for two samples in a row before contact + .75 s."""
    ok = records.where(F.col("direct") & F.col("track_id").isNotNull() & (F.col("touch") <= reach) & (F.col("t_ms") <= F.col("contact_ms") + 750))
    w = by_time()
    twice = ok.withColumn("again", F.lag("track_id").over(w) == F.col("track_id")).where("again")
    return twice.groupBy(*SCENE).agg(F.min(F.struct("t_ms", "track_id")).alias("f")).select(*SCENE, F.col("f.track_id").alias("origin_id"), F.col("f.t_ms").alias("lock_ms"))


def identity_switches(records: DataFrame) -> DataFrame:
    """Changes of the subject, ignoring samples without one."""
    prev = F.last("track_id", ignorenulls=True).over(before())
    rows = records.withColumn("swap", F.col("track_id") != prev)
    return rows.groupBy(*SCENE).agg(F.count(F.when(F.col("swap"), 1)).alias("switches"))


def scale_cuts(frames: DataFrame, people: DataFrame, window_ms: int = 650) -> DataFrame:
    """Frames whose subject scale and count differ from a recent frame of the same shot.

    Each comparison needs only flags of the earlier frame, so a range frame
    replaces the self join. A cut row is also compared with the shot it leaves.
    """
    per = people.where("confidence >= 0.45").groupBy(*SCENE, "frame").agg(F.array_sort(F.collect_list(F.col("y2") - F.col("y1"))).alias("h"))
    n, top = F.size("h"), F.element_at("h", -1)
    second, mid = F.try_element_at("h", F.lit(-2)), F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))
    flags = per.select(
        *SCENE, "frame", ((top > 0.55) & ((n == 1) | (second < top * 0.4))).alias("fg"), ((n >= 3) & (mid < 0.25) & (top < 0.4)).alias("av"),
        ((n <= 2) & (mid > 0.30)).alias("cu"), ((n >= 4) & (mid < 0.18)).alias("wd"))
    rows = with_shot(frames).join(flags, [*SCENE, "frame"], "left").select(*SCENE, "frame", "t_ms", "cut", "shot", "fg", "av", "cu", "wd")
    old = rows.where("cut").withColumns(dict(shot=F.col("shot") - 1, src=F.lit(False), probe=F.lit(True)))
    own = rows.withColumns(dict(src=F.lit(True), probe=~F.col("cut")))
    w = Window.partitionBy(*SHOT).orderBy("t_ms").rangeBetween(-window_ms, -1)
    seen = lambda c: F.coalesce(F.max((F.col("src") & F.coalesce(c, F.lit(False))).cast("int")).over(w) == 1, F.lit(False))
    both = own.unionByName(old)
    hit = (F.col("fg") & seen(F.col("av"))) | (F.col("av") & seen(F.col("fg"))) | (F.col("cu") & seen(F.col("wd"))) | (F.col("wd") & seen(F.col("cu")))
    return both.withColumn("hit", F.coalesce(hit, F.lit(False))).where("probe").groupBy(*SCENE, "frame").agg(F.bool_or("hit").alias("scale_cut"))


def reacquire_hint(frames: DataFrame, balls: DataFrame, max_ms: int = 750) -> DataFrame:
    """The only plausible weak ball near the last direct one, if exactly one exists."""
    seed = F.last(F.when(F.col("ball_x").isNotNull(), F.struct("t_ms", "ball_x", "ball_y")), ignorenulls=True).over(before())
    rows = frames.withColumn("s", seed).where(F.col("t_ms") - F.col("s.t_ms") <= max_ms).select(*SCENE, "frame", "t_ms", "s")
    c = F.col
    reach = 0.025 + 0.9 * (c("t_ms") - c("s.t_ms")) / 1000
    ok = (
        (c("confidence") >= 0.04) & (c("pitch_support") >= 0.10) & (c("x2") - c("x1") > 0) & (c("x2") - c("x1") <= 0.02) & (c("y2") - c("y1") > 0)
        & (c("y2") - c("y1") <= 0.035) & c("cy").between(0.12, 0.97) & (F.sqrt(F.pow(c("cx") - c("s.ball_x"), 2) + F.pow((c("cy") - c("s.ball_y")) * 0.6, 2)) <= reach))
    near = balls.drop("t_ms").join(rows, [*SCENE, "frame"]).where(ok)
    return near.groupBy(*SCENE, "frame").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")).where("n = 1").drop("n")


def backfill_scorer(records: DataFrame, players: DataFrame, scorers: DataFrame) -> DataFrame:
    """Replace the subject by the known scorer in setup and contact while they are at the ball."""
    from matchspark.operators.linking import touch_distance_expr

    man = players.select(*SCENE, "frame", F.col("track_id").alias("scorer_id"), "cx", "x1", "x2", "y1", "y2")
    one = man.groupBy(*SCENE, "frame", "scorer_id").agg(F.min(F.struct("cx", "x1", "x2", "y1", "y2")).alias("m"))
    rows = records.join(scorers, SCENE, "left").join(one, [*SCENE, "frame", "scorer_id"], "left").select(
        *records.columns, "scorer_id", "contact_ms", F.col("m.cx").alias("cx"), F.col("m.x1").alias("x1"), F.col("m.x2").alias("x2"), F.col("m.y1").alias("y1"), F.col("m.y2").alias("y2"))
    rows = rows.withColumns(dict(bx=F.col("ball_x"), by=F.col("ball_y")))
    ok = F.col("phase").isin("setup", "contact") & (F.col("t_ms") <= F.col("contact_ms") + 250) & (touch_distance_expr(0.52) <= 0.13)
    ok = F.coalesce(ok, F.lit(False))
    return rows.select(
        *SCENE, "frame", F.when(ok, F.col("scorer_id")).otherwise(F.col("track_id")).alias("track_id"), ok.alias("replaced"),
        r5(F.when(ok, F.col("bx") * 0.72 + F.col("cx") * 0.28).otherwise(F.col("target_x"))).alias("target_x"))


def stable_targets(records: DataFrame) -> DataFrame:
    """One held target per shot and phase when all frameable rows share an interval."""
    rows = with_shot(records)
    early = F.col("phase").isin("setup", "contact")
    g = rows.where(early & F.col("joint_fit")).groupBy(*SHOT, "phase").agg(F.max("lo").alias("l"), F.min("hi").alias("h"), F.median("target_x").alias("m"))
    held = g.where("l <= h").select(*SHOT, "phase", F.greatest("l", F.least("h", "m")).alias("held"))
    return rows.join(held, [*SHOT, "phase"], "left").select(*SCENE, "frame", r5(F.coalesce("held", "target_x")).alias("target_x"), F.col("held").isNotNull().alias("held"))


def carry_bounds(records: DataFrame, view: float, hold_ms: int = 650, bridge_ms: int = 1_250) -> DataFrame:
    """Hold the last constrained interval briefly; release it between two distant direct balls."""
    g0, g1 = view / 2, 1 - view / 2
    rows = with_shot(records)
    obs = F.when(F.col("direct"), F.struct("t_ms", "ball_x"))
    rows = rows.withColumns(dict(p=F.last(obs, ignorenulls=True).over(before(SHOT)), q=F.first(obs, ignorenulls=True).over(after(SHOT))))
    gap = F.col("q.t_ms") - F.col("p.t_ms")
    free = ~F.col("direct") & (gap > 0) & (gap <= bridge_ms) & (F.abs(F.col("q.ball_x") - F.col("p.ball_x")) > view * 0.4)
    rows = rows.withColumn("free", F.coalesce(free, F.lit(False)))
    rows = rows.withColumn("leg", F.sum(F.col("free").cast("int")).over(by_time(SHOT).rowsBetween(Window.unboundedPreceding, 0)))
    bound = ~F.col("free") & ((F.col("lo") != g0) | (F.col("hi") != g1))
    last = F.last(F.when(bound, F.struct("t_ms", "lo", "hi")), ignorenulls=True).over(
        Window.partitionBy(*SHOT, "leg").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns(dict(bound=bound, held=last))
    carry = ~F.col("bound") & ~F.col("free") & (F.col("t_ms") - F.col("held.t_ms") <= hold_ms)
    value = lambda c, wide: F.when(F.col("bound"), F.col(c)).when(F.coalesce(carry, F.lit(False)), F.col(f"held.{c}")).otherwise(F.lit(wide))
    return rows.select(*SCENE, "frame", value("lo", g0).alias("lo"), value("hi", g1).alias("hi"), F.col("free").alias("released"))


def reachable_bounds(rows: DataFrame, speed: float) -> DataFrame:
    """Speed-feasible interval per row: the backward recursion as two suffix windows."""
    tail = by_time(SHOT).rowsBetween(0, Window.unboundedFollowing)
    t = F.col("t_ms") * F.lit(speed / 1000)
    low = F.max(F.col("lo") - t).over(tail) + t
    high = F.min(F.col("hi") + t).over(tail) - t
    return rows.withColumns(dict(reach_lo=low, reach_hi=high)).withColumn("feasible", F.col("reach_lo") <= F.col("reach_hi") + 1e-9)


def lazy_path(rows: DataFrame, speed: float) -> DataFrame:
    """Camera that moves only when its reachable interval forces it to. A shot is a bounded group."""
    r = reachable_bounds(rows, speed)
    item = F.struct("t_ms", "frame", "reach_lo", "reach_hi")
    init = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<frame:bigint,x:double>>").alias("out"))

    def step(acc, i):
        lim = (i["t_ms"] - acc["t"]) * speed / 1000
        lo, hi = F.greatest(i["reach_lo"], acc["x"] - lim), F.least(i["reach_hi"], acc["x"] + lim)
        x = F.when(acc["x"].isNull(), (i["reach_lo"] + i["reach_hi"]) / 2).otherwise(F.least(hi, F.greatest(lo, acc["x"])))
        return F.struct(x.alias("x"), i["t_ms"].alias("t"), F.concat(acc["out"], F.array(F.struct(i["frame"].alias("frame"), x.alias("x")))).alias("out"))

    return fold(r, SHOT, item, init, step).select(*SHOT, F.explode("state.out").alias("o")).select(*SCENE, "o.frame", r5("o.x").alias("camera_x"))


def shot_speed(rows: DataFrame) -> DataFrame:
    """Speed tier of each shot: fixed, calm, normal, then flight-only handoffs."""
    out = rows
    for name, v in (("a", 0.22), ("b", 0.35), ("c", 1.5), ("d", 3.0)):
        out = reachable_bounds(out, v).withColumnRenamed("feasible", name).drop("reach_lo", "reach_hi")
    prev = F.lag(F.struct("phase", "ball_x")).over(by_time(SHOT))
    pair = (F.col("phase") == "flight") & (prev["phase"] == "flight") & F.col("ball_x").isNotNull() & prev["ball_x"].isNotNull()
    g = out.withColumn("pair", pair).groupBy(*SHOT).agg(
        (F.max("lo") <= F.min("hi")).alias("fixed"), *[F.bool_and(c).alias(c) for c in "abcd"], F.count(F.when(F.col("pair"), 1)).alias("pairs"))
    tier = F.when(F.col("fixed"), "fixed").when(F.col("a"), "calm").when(F.col("b"), "normal").when(F.col("pairs") < 2, "infeasible").when(F.col("c"), "flight").when(F.col("d"), "handoff").otherwise("infeasible")
    return g.select(*SHOT, tier.alias("tier"))


def ema_velocity(records: DataFrame, decay: float = 0.76) -> DataFrame:
    """Smoothed ball velocity: updates on direct balls, decays while only guided, resets when lost. Fold per scene."""
    item = F.struct("t_ms", "frame", "direct", F.col("ball_x").alias("x"), F.col("guide_x").alias("g"))
    init = F.struct(F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<frame:bigint,v:double>>").alias("out"))

    def step(acc, i):
        gap = F.greatest(F.lit(0.001), (i["t_ms"] - acc["t"]) / 1000)
        fresh = F.least(F.lit(1.1), F.greatest(F.lit(-1.1), acc["v"] * 0.6 + (i["x"] - acc["x"]) / gap * 0.4))
        hit = i["direct"] & i["x"].isNotNull()
        v = F.when(hit, F.when(acc["x"].isNull(), acc["v"]).otherwise(fresh)).when(i["g"].isNotNull(), acc["v"] * decay).otherwise(0.0)
        x = F.when(hit, i["x"]).otherwise(i["g"])
        return F.struct(v.alias("v"), x.alias("x"), i["t_ms"].alias("t"), F.concat(acc["out"], F.array(F.struct(i["frame"].alias("frame"), v.alias("v")))).alias("out"))

    return fold(records, SCENE, item, init, step).select(*SCENE, F.explode("state.out").alias("o")).select(*SCENE, "o.frame", r5("o.v").alias("velocity"))


def handoff_cuts(path: DataFrame) -> DataFrame:
    """Camera steps that must render as a cut rather than a whip."""
    w = by_time()
    dt = F.col("t_ms") - F.lag("t_ms").over(w)
    step = F.abs(F.col("camera_x") - F.lag("camera_x").over(w))
    swap = ~F.col("owner").eqNullSafe(F.lag("owner").over(w)) | (F.col("has_ball") != F.lag("has_ball").over(w))
    jump = (dt > 0) & (dt <= 260) & ((step >= 0.28) | ((step >= 0.14) & swap))
    later = F.lag("frame").over(w).isNotNull()
    return path.select(*SCENE, "frame", (later & (F.col("cut") | F.coalesce(jump, F.lit(False)))).alias("handoff_cut"))


def marker_runs(keyframes: DataFrame, n_min: int = 3) -> DataFrame:
    """Eligible marker samples lasting at least three rows on one track."""
    w = by_time()
    ok = F.col("eligible") & F.col("track_id").isNotNull()
    same = ok & F.coalesce(F.lag(ok).over(w) & (F.lag("track_id").over(w) == F.col("track_id")), F.lit(False))
    rows = keyframes.withColumns(dict(ok=ok, turn=F.when(same, 0).otherwise(1)))
    rows = rows.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*SCENE, "run"))
    return rows.select(*SCENE, "frame", "t_ms", "subject_confidence", (F.col("ok") & (size >= n_min)).alias("visible"))


def overlay_span(keyframes: DataFrame) -> DataFrame:
    """First and last visible time of the marker and its upper-median confidence."""
    g = marker_runs(keyframes).where("visible").groupBy(*SCENE).agg(
        F.min("t_ms").alias("a"), F.max("t_ms").alias("b"), F.array_sort(F.collect_list("subject_confidence")).alias("c"))
    return g.select(*SCENE, F.col("a").alias("start_ms"), F.greatest(F.col("a") + 100, F.col("b") + 120).alias("end_ms"),
                    F.element_at("c", (F.floor(F.size("c") / 2) + 1).cast("int")).alias("confidence"))


def payoff_run(keyframes: DataFrame, need_ms: int = 500, step_ms: int = 160) -> DataFrame:
    """First continuous run of valid payoff frames lasting half a second, up to the moment it does."""
    w = by_time()
    ok = F.col("valid")
    brk = ~F.coalesce(F.lag(ok).over(w), F.lit(False)) | F.col("cut") | (F.col("t_ms") - F.lag("t_ms").over(w) > step_ms)
    rows = keyframes.withColumn("leg", F.sum(F.when(ok & F.coalesce(brk, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("valid")
    start = F.min("t_ms").over(Window.partitionBy(*SCENE, "leg"))
    done = rows.withColumn("from_ms", start).where(F.col("t_ms") - F.col("from_ms") >= need_ms)
    return done.groupBy(*SCENE).agg(F.min(F.struct("t_ms", "from_ms")).alias("r")).select(*SCENE, F.col("r.from_ms").alias("start_ms"), F.col("r.t_ms").alias("end_ms"))


def bracketed_gap(obs: DataFrame, max_ms: int = 400) -> DataFrame:
    """Missing rows seen on both sides within the limit inside one shot."""
    rows = with_shot(obs)
    at = F.when(F.col("ball_x").isNotNull(), F.col("t_ms"))
    rows = rows.withColumns(dict(a=F.last(at, ignorenulls=True).over(before(SHOT)), b=F.first(at, ignorenulls=True).over(after(SHOT))))
    return rows.where("ball_x IS NULL").select(*SCENE, "frame", F.coalesce(F.col("b") - F.col("a") <= max_ms, F.lit(False)).alias("bracketed"))


def spike_rows(obs: DataFrame) -> DataFrame:
    """Isolated ball jumps: neighbours agree while the row is far from both."""
    w = by_time()
    dist = lambda ax, ay, bx, by: F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))
    x, y = F.col("ball_x"), F.col("ball_y")
    px, py, nx, ny = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    rows = obs.withColumns(dict(ac=dist(px, py, nx, ny), ab=dist(px, py, x, y), bc=dist(x, y, nx, ny), nc=F.lead("cut").over(w)))
    ok = ~F.col("cut") & ~F.col("nc") & F.col("situation").isin("possession", "receive", "release") & (F.col("ac") < 0.08) & (F.col("ab") > 0.12) & (F.col("bc") > 0.12)
    return rows.where(ok).select(*SCENE, "frame")


def recheck_rows(obs: DataFrame, targets: DataFrame, maximum: int = 12) -> DataFrame:
    """Rows to observe again under a budget: targets first, then their neighbours."""
    near = targets.select(*SCENE, F.explode(F.array(
        F.struct(F.lit(0).alias("p"), F.col("frame")), F.struct(F.lit(1).alias("p"), (F.col("frame") - 1).alias("frame")), F.struct(F.lit(1).alias("p"), (F.col("frame") + 1).alias("frame")))).alias("c"), F.col("frame").alias("src"))
    cand = near.select(*SCENE, "c.p", "c.frame", "src").join(obs.select(*SCENE, "frame"), [*SCENE, "frame"], "left_semi")
    first = cand.groupBy(*SCENE, "frame").agg(F.min(F.struct("p", "src", F.col("frame").alias("f"))).alias("o"))
    rank = F.row_number().over(Window.partitionBy(*SCENE).orderBy("o"))
    return first.withColumn("rn", rank).where(F.col("rn") <= maximum).select(*SCENE, "frame")


def lead_in_trim(obs: DataFrame, view: float) -> DataFrame:
    """Offset removing an unframeable opening before the first touch, if the rest fits."""
    w = by_time()
    touch = (F.col("phase") == "contact") | (F.col("situation") == "release")
    fits = F.coalesce(F.greatest("ball_x2", "px2") - F.least("ball_x1", "px1") <= view, F.lit(False))
    first_touch = F.min(F.when(touch, F.col("t_ms"))).over(Window.partitionBy(*SCENE))
    rows = obs.withColumns(dict(fits=fits, touch_ms=first_touch)).withColumn("opening", F.col("t_ms") < F.col("touch_ms"))
    clean = (F.col("phase") == "setup") & F.col("ball_x1").isNotNull() & F.col("px1").isNotNull() & (~F.col("cut") | (F.lag("frame").over(w).isNull()))
    g = rows.withColumn("clean", clean).groupBy(*SCENE).agg(
        F.min("t_ms").alias("t0"), F.max("touch_ms").alias("touch_ms"), F.max("t_ms").alias("t1"), F.coalesce(F.bool_and(F.when(F.col("opening"), F.col("clean"))), F.lit(False)).alias("clean"),
        F.min(F.when(F.col("opening") & F.col("fits"), F.col("t_ms"))).alias("off"),
        F.max(F.when((F.col("t_ms") <= F.col("touch_ms")) & ~F.col("fits"), F.col("t_ms"))).alias("bad"))
    ok = (
        F.col("clean") & (F.col("touch_ms") > F.col("t0")) & (F.col("touch_ms") <= 4_000) & (F.col("off") > F.col("t0")) & (F.col("off") <= 3_500)
        & (F.col("touch_ms") - F.col("off") >= 100) & (F.col("bad") < F.col("off")))
    return g.where(ok).select(*SCENE, F.col("off").alias("offset_ms"))


def freeze_anchor(records: DataFrame, requests: DataFrame, tol_ms: int = 150) -> DataFrame:
    """Nearest record starting three direct rows around the requested instant."""
    w = by_time()
    n1, n2 = F.lead("direct", 1).over(w), F.lead("direct", 2).over(w)
    c1, c2 = F.lead("cut", 1).over(w), F.lead("cut", 2).over(w)
    ok = F.col("direct") & n1 & n2 & ~c1 & ~c2 & F.col("joint_fit") & (F.col("subject_confidence") >= 0.85)
    rows = records.withColumn("ok", ok).where("ok").join(requests, SCENE)
    near = rows.where(F.abs(F.col("t_ms") - F.col("want_ms")) <= tol_ms)
    return near.groupBy(*SCENE).agg(F.min_by("t_ms", F.struct(F.abs(F.col("t_ms") - F.col("want_ms")), "t_ms")).alias("anchor_ms"))


def opening_lock(keyframes: DataFrame) -> DataFrame:
    """Whether any five rows of the opening second hold three direct joint rows."""
    head = keyframes.where("t_ms <= 1050")
    five = by_time().rowsBetween(0, 4)
    rows = head.withColumns(dict(s=F.sum((F.col("direct") & F.col("joint_fit")).cast("int")).over(five), n=F.count(F.lit(1)).over(five)))
    return rows.groupBy(*SCENE).agg(F.bool_or((F.col("s") >= 3) & (F.col("n") == 5)).alias("opening"))


def motion_path(records: DataFrame, anchors: DataFrame, reach_ms: int = 600) -> DataFrame:
    """Ball points after the anchor until the first row without a direct ball or past a cut."""
    rows = records.join(anchors, SCENE).where((F.col("t_ms") >= F.col("anchor_ms")) & (F.col("t_ms") - F.col("anchor_ms") <= reach_ms))
    good = F.col("direct") & F.col("ball_x").isNotNull() & (~F.col("cut") | (F.col("t_ms") == F.col("anchor_ms")))
    run = F.min(good.cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("run", run).where("run = 1")
    n = F.count(F.lit(1)).over(Window.partitionBy(*SCENE))
    return kept.withColumn("n", n).where("n >= 3").select(*SCENE, "frame", "ball_x", "ball_y")


def pass_events(records: DataFrame, reach_ms: int = 5_000) -> DataFrame:
    """Carrier to receiver: three controlled direct rows of another track within reach, no cut between."""
    rows = with_shot(records)
    w = by_time(SHOT)
    hold = F.col("possession") & F.col("direct") & (F.col("subject_confidence") >= 0.70) & F.col("track_id").isNotNull()
    rows = rows.withColumn("hold", hold)
    rows = rows.withColumn("turn", F.when(
        F.col("hold") & F.coalesce(F.lag("hold").over(w) & (F.lag("track_id").over(w) == F.col("track_id")), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("leg", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("hold").groupBy(*SHOT, "leg", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    order = Window.partitionBy(*SHOT).orderBy("a")
    got = runs.withColumns(dict(from_id=F.lag("track_id").over(order), from_ms=F.lag("b").over(order)))
    return got.where((F.col("n") >= 3) & (F.col("from_id") != F.col("track_id")) & (F.col("a") - F.col("from_ms") <= reach_ms)).select(
        *SCENE, "from_id", F.col("track_id").alias("to_id"), "from_ms", F.col("a").alias("to_ms"))


def pass_network_run(rows: DataFrame, gap_ms: int = 240, n_min: int = 6, span_ms: int = 360) -> DataFrame:
    """Latest contiguous run of usable rows before the pass, long enough to animate."""
    w = by_time()
    turn = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > gap_ms, F.lit(True))
    legs = rows.where("usable").withColumn("turn", turn).withColumn("leg", F.sum(F.col("turn").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = legs.groupBy(*SCENE, "leg").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    last = g.groupBy(*SCENE).agg(F.max(F.struct("leg", "n", "a", "b")).alias("r")).select(*SCENE, "r.n", "r.a", "r.b")
    return last.where((F.col("n") >= n_min) & (F.col("b") - F.col("a") >= span_ms)).select(*SCENE, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.col("n").alias("samples"))


def resample(records: DataFrame, step_ms: int = 50, radius: int = 2) -> DataFrame:
    """Linear resampling of observed balls on a fixed grid, then a rolling median."""
    obs = records.where("ball_x IS NOT NULL").select(*SCENE, "t_ms", "ball_x")
    nxt = F.lead(F.struct("t_ms", "ball_x")).over(by_time())
    legs = obs.withColumn("n", nxt).withColumn("end_ms", F.coalesce(F.col("n.t_ms") - 1, F.col("t_ms")))
    t0 = F.min("t_ms").over(Window.partitionBy(*SCENE))
    legs = legs.withColumn("t0", t0)
    first = F.ceil((F.col("t_ms") - F.col("t0")) / F.lit(step_ms))
    last = F.floor((F.col("end_ms") - F.col("t0")) / F.lit(step_ms))
    grid = legs.where(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    at = F.col("t0") + F.col("i") * step_ms
    a = F.coalesce((at - F.col("t_ms")) / (F.col("n.t_ms") - F.col("t_ms")), F.lit(0.0))
    x = F.col("ball_x") * (1 - a) + F.coalesce("n.ball_x", "ball_x") * a
    pts = grid.select(*SCENE, at.alias("t_ms"), x.alias("x"))
    around = by_time().rowsBetween(-radius, radius)
    return pts.select(*SCENE, "t_ms", r5(F.percentile("x", 0.5).over(around)).alias("x"))


def search_regions(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ball search region per frame: the nearest anchor within .2 s, else between two anchors of one shot."""
    both = frames.select(*SCENE, "frame", "t_ms", "cut", F.lit(None).cast("double").alias("ax"), F.lit(0).alias("kind")).unionByName(
        anchors.select(*SCENE, F.lit(None).cast("long").alias("frame"), F.col("a_ms").alias("t_ms"), F.lit(False).alias("cut"), F.col("a_x").alias("ax"), F.lit(1).alias("kind")))
    w = Window.partitionBy(*SCENE).orderBy("t_ms", "kind")
    rows = both.withColumn("cuts", F.sum(F.col("cut").cast("int")).over(Window.partitionBy(*SCENE).orderBy("t_ms")))
    hit = F.when(F.col("kind") == 1, F.struct("t_ms", "ax", "cuts"))
    rows = rows.withColumns(dict(
        p=F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), q=F.first(hit, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))).where("kind = 0")
    dp, dq = F.col("t_ms") - F.col("p.t_ms"), F.col("q.t_ms") - F.col("t_ms")
    use_p = dp.isNotNull() & (dp <= 200) & (dq.isNull() | (dp <= dq))
    use_q = dq.isNotNull() & (dq <= 200)
    a = dp / (dp + dq)
    mid = (F.col("p.cuts") == F.col("q.cuts")) & (dp + dq <= 4_000)
    x = F.when(use_p, F.col("p.ax")).when(use_q, F.col("q.ax")).when(mid, F.col("p.ax") * (1 - a) + F.col("q.ax") * a)
    r = F.when(use_p, 0.025 + dp * 0.00035).when(use_q, 0.025 + dq * 0.00035).when(mid, F.least(F.lit(0.10), 0.025 + F.least(dp, dq) * 0.00012))
    return rows.where(x.isNotNull()).select(*SCENE, "frame", r5(x).alias("x"), r5(r).alias("radius"), (use_p | use_q).alias("observed"))


# -- per-row geometry ---------------------------------------------------------


def camera_owner(records: DataFrame) -> DataFrame:
    early = F.col("phase").isin("setup", "contact")
    owner = F.when(F.col("joint_visible") & (early | F.col("possession")), "carrier").when(early, "hold").when(F.col("tracked_ball"), "ball").when(F.col("phase") == "payoff", "payoff").otherwise("hold")
    return records.withColumn("owner", owner)


def subject_confidence(records: DataFrame) -> DataFrame:
    """Weighted confidence from detection, proximity, track age and ball quality."""
    one = lambda c, top=1.0: F.least(F.lit(top), F.greatest(F.lit(0.0), c))
    near = one(1 - F.coalesce("touch", F.lit(0.5)) / 0.20)
    ball = F.when(F.col("direct"), one(F.col("ball_confidence") / 0.45)).otherwise(one(F.col("ball_confidence") / 0.20, 0.55))
    total = F.col("confidence") * 0.30 + near * 0.28 + one(F.coalesce("track_age", F.lit(1)) / 5.0) * 0.22 + ball * 0.20
    return records.withColumn("subject_confidence", F.round(one(total), 4))


def in_crop(records: DataFrame, view_w: float, view_h: float = 1.0) -> DataFrame:
    """Ball and player containment in the crop and their joint fit."""
    m = F.when(F.col("phase").isin("setup", "contact"), min(0.035, view_w * 0.11)).otherwise(0.0)
    inside = lambda x, y, k: F.coalesce(
        (F.abs(F.col(x) - F.col("camera_x")) <= view_w / 2 - k) & (F.abs(F.col(y) - 0.5) <= view_h / 2 - k), F.lit(False))
    joint = inside("ball_x", "ball_y", m) & inside("px1", "ptop", m) & inside("px2", "pbottom", m)
    return records.withColumns(dict(ball_in=inside("ball_x", "ball_y", F.lit(0.0)), player_in=inside("px1", "ptop", m) & inside("px2", "pbottom", m), joint_in=joint))


def payoff_target(records: DataFrame, moments: DataFrame) -> DataFrame:
    """Records whose time falls in a proven outcome box; goals hold it to the scene end."""
    box = (F.col("box_x1") < F.col("box_x2")) & (F.col("box_y1") < F.col("box_y2")) & (F.col("box_x1") >= 0) & (F.col("box_x2") <= 1) & (F.col("box_y1") >= 0) & (F.col("box_y2") <= 1)
    goal = F.col("event_type") == "goal"
    centre = (F.col("box_x1") + F.col("box_x2")) / 2
    side = ~goal | F.col("goal_focus_x").isNull() | (F.abs(centre - F.col("goal_focus_x")) <= F.greatest(F.lit(0.18), (F.col("box_x2") - F.col("box_x1")) * 0.75))
    ok = S.is_true("proof_verified") & (F.col("proof_event") == F.col("event_type")) & box & side & (F.col("proof_end_ms") - F.col("proof_start_ms") >= 500)
    until = F.when(F.col("event_type").isin(*S.SCORING), F.greatest("proof_end_ms", "end_ms")).otherwise(F.col("proof_end_ms"))
    m = moments.where(ok).select("match_id", "moment_id", F.col("proof_start_ms").alias("b0"), until.alias("b1"))
    return records.join(m, ["match_id", "moment_id"], "left").withColumn("on_target", F.coalesce(F.col("at_ms").between(F.col("b0"), F.col("b1")), F.lit(False)))


def project_pitch(players: DataFrame, matrices: DataFrame, share: float = 0.8) -> DataFrame:
    """Foot positions in pitch metres for frames where enough players land on the pitch.

    ``matrices`` holds one row of nine coefficients per scene.
    """
    c = F.col
    w = c("h20") * c("fx") + c("h21") * c("fy") + c("h22")
    x, y = (c("h00") * c("fx") + c("h01") * c("fy") + c("h02")) / w, (c("h10") * c("fx") + c("h11") * c("fy") + c("h12")) / w
    pts = players.join(matrices, SCENE).withColumns(dict(pitch_x=x, pitch_y=y)).withColumn("on", c("pitch_x").between(0, 105) & c("pitch_y").between(0, 68))
    good = pts.groupBy(*SCENE, "frame").agg(F.avg(c("on").cast("double")).alias("s")).where(F.col("s") >= share).select(*SCENE, "frame")
    return pts.join(good, [*SCENE, "frame"], "left_semi").where("on").select(*SCENE, "frame", "idx", F.round("pitch_x", 3).alias("pitch_x"), F.round("pitch_y", 3).alias("pitch_y"))


def plausible_balls(balls: DataFrame, people: DataFrame, view: float, width: float = 1080, aspect: float = 16 / 9) -> DataFrame:
    """Balls whose size suits the players of their frame."""
    h = (F.col("y2") - F.col("y1")) / aspect / view * width
    on = people.where("pitch_support >= 0.08")
    shot = on.where("role <> 'referee'").groupBy(*SCENE, "frame").agg(F.array_sort(F.collect_list(h)).alias("hs")).select(
        *SCENE, "frame", F.element_at("hs", (F.least(F.size("hs") - 1, F.floor(F.size("hs") * 0.75)) + 1).cast("int")).alias("shot_body"))
    man = on.select(*SCENE, "frame", F.col("cx").alias("mx"), F.col("y2").alias("my"), h.alias("mh"))
    near = balls.join(man, [*SCENE, "frame"]).where(F.sqrt(F.pow(F.col("cx") - F.col("mx"), 2) + F.pow((F.col("cy") - F.col("my")) / aspect, 2)) <= 0.12)
    body = near.groupBy(*SCENE, "frame", "idx").agg(F.max("mh").alias("near_body"))
    size = F.greatest(F.col("x2") - F.col("x1"), (F.col("y2") - F.col("y1")) / aspect) / view * width
    top = F.greatest(F.lit(70.0), F.least(F.lit(240.0), F.greatest(F.coalesce("shot_body", F.lit(0.0)), F.coalesce("near_body", F.lit(0.0))) * 0.25))
    rows = balls.join(shot, [*SCENE, "frame"], "left").join(body, [*SCENE, "frame", "idx"], "left")
    return rows.where(size.between(4, top)).select(*SCENE, "frame", "idx", F.round(size, 4).alias("diameter"))


def adaptive_thin(frames: DataFrame, dense: int = 10, coarse: int = 4) -> DataFrame:
    """One frame per tick, dense near the action and coarse elsewhere."""
    t = F.col("t_ms")
    near = (F.col("length_ms") <= 6_000) | (t <= 1_000) | t.between(F.greatest(F.lit(0), F.col("contact_ms") - 1_750), F.least("length_ms", F.col("payoff_ms") + 1_250))
    rate = F.when(near, dense).otherwise(coarse)
    rows = frames.withColumns(dict(rate=rate, tick=F.floor(t * rate / 1000)))
    prev = F.lag(F.struct("rate", "tick")).over(by_time())
    return rows.withColumn("prev", prev).where(F.col("prev").isNull() | (F.col("prev.rate") != F.col("rate")) | (F.col("prev.tick") != F.col("tick"))).select(*SCENE, "frame")


def kit_distance(pairs: DataFrame) -> DataFrame:
    """Bhattacharyya distance of two L1-normalised histograms ``a`` and ``b``; 1 when one is missing."""
    coef = F.aggregate(F.zip_with("a", "b", lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    d = F.sqrt(F.greatest(F.lit(0.0), 1 - coef))
    return pairs.withColumn("distance", F.round(F.when(F.col("a").isNull() | F.col("b").isNull(), 1.0).otherwise(F.least(F.lit(1.0), d)), 4))


def simplify_path(keyframes: DataFrame, tolerance: float) -> DataFrame:
    """Control points of each shot's path by recursive farthest-point splitting, many bounded shots in one call."""
    rows = with_shot(keyframes).select(*SHOT, "frame", "t_ms", "camera_x")
    walk = functools.partial(control_points, tolerance=tolerance)
    return in_groups(rows, SHOT, ["t_ms"], walk, "match_id long, scene_id long, shot long, frame long, camera_x double")


def associate_people(frames: DataFrame, people: DataFrame, ttl_ms: int = 750) -> DataFrame:
    """Track ids by greedy matching on motion, overlap and size. A cut ends all tracks; ids go on counting through the scene.

    Sequential by nature: bounded scenes are walked frame by frame, many of them in one call.
    """
    shots = with_shot(frames).select(*SCENE, "frame", "shot")
    rows = people.select(*SCENE, "frame", "t_ms", "idx", "cx", "x1", "y1", "x2", "y2", "kit").join(shots, [*SCENE, "frame"])
    walk = functools.partial(tracks, ttl_ms=ttl_ms)
    return in_groups(rows, SCENE, ["t_ms", "idx"], walk, "match_id long, scene_id long, frame long, idx long, track_id long, track_age long")


def associate_ball(frames: DataFrame, balls: DataFrame, beam: int = 24, top: int = 8, miss: float = 2.5) -> DataFrame:
    """One coherent ball path per shot by beam search; missing frames stay missing.

    Candidates are filtered and priced as columns before the search, so a Python
    worker only sees bounded shots, many at once, with at most ``top`` balls per frame.
    Frames of a verified goal route (``route``, if ``frames`` has it) keep twice as
    many, because a small true ball is often the less sure one, and a miss costs 4.
    """
    ok = balls.where("confidence >= 0.12 AND (pitch_support >= 0.1 OR near <= 0.11)")
    price = -F.log(F.greatest(F.lit(0.01), F.col("confidence"))) + F.least(F.lit(0.8), F.col("near") * 3)
    rank = F.row_number().over(Window.partitionBy(*SCENE, "frame").orderBy(F.desc("confidence"), "idx"))
    cand = ok.withColumns(dict(price=price, rn=rank)).where(F.col("rn") <= 2 * top).select(*SCENE, "frame", "idx", "cx", "cy", "price", "rn")
    route = F.coalesce(F.col("route"), F.lit(False)) if "route" in frames.columns else F.lit(False)
    rows = with_shot(frames.withColumn("route", route)).select(*SHOT, "frame", "t_ms", "route").join(cand, [*SCENE, "frame"], "left")
    rows = rows.where(F.col("rn").isNull() | (F.col("rn") <= F.when(F.col("route"), 2 * top).otherwise(top))).drop("rn")

    rows = rows.withColumns(dict(seen=F.col("idx").isNotNull(), idx=F.coalesce("idx", F.lit(0)).cast("long")))
    walk = functools.partial(beam_search, beam=beam, miss=miss)
    schema = "match_id long, scene_id long, frame long, idx long, cx double, cy double"
    return in_groups(rows, SHOT, ["t_ms", "frame", "price", "idx"], walk, schema)


# -- planning from observations ------------------------------------------------


def required_interval(obs: DataFrame, view: float) -> DataFrame:
    """Allowed crop centre from every required observed box of a row, or an issue.

    Boxes are ``b``/``p``/``k``/``g`` (ball, player, keeper, post) with ``*_x1`` and ``*_x2``; null when unseen.
    """
    half, margin = view / 2, min(0.015, view * 0.05)
    c = F.col
    span = lambda a, b: F.greatest(F.lit(0.0), c(f"{a}_x1") - c(f"{b}_x2"), c(f"{b}_x1") - c(f"{a}_x2"))
    rise = lambda a, b: F.greatest(F.lit(0.0), c(f"{a}_y1") - c(f"{b}_y2"), c(f"{b}_y1") - c(f"{a}_y2"))
    gap = lambda a, b: F.sqrt(F.pow(span(a, b), 2) + F.pow(rise(a, b), 2))
    fits = lambda a, b: F.greatest(f"{a}_x2", f"{b}_x2") - F.least(f"{a}_x1", f"{b}_x1") <= view
    seen = lambda a: c(f"{a}_x1").isNotNull()
    moving = c("phase").isin("flight", "continuation", "payoff")
    final = (c("phase") == "payoff") & (c("situation") == "result")
    shot = c("event_type").isin(*S.SHOTS)
    closed = c("ball_in_play").eqNullSafe(F.lit(False)) | c("event_type").isin(*S.SCORING)
    keeper = seen("k") & seen("b") & moving & ((gap("k", "b") <= 0.08) | (final & shot & closed)) & fits("k", "b")
    post = seen("g") & seen("b") & c("phase").isin("flight", "payoff") & ((gap("g", "b") <= 0.12) | (final & shot & fits("g", "b")))
    use = {"b": seen("b"), "p": seen("p") & c("need_player"), "k": F.coalesce(keeper, F.lit(False)), "g": F.coalesce(post, F.lit(False))}
    left = F.least(*[F.when(ok, c(f"{n}_x1")) for n, ok in use.items()])
    right = F.greatest(*[F.when(ok, c(f"{n}_x2")) for n, ok in use.items()])
    safe = F.greatest(F.lit(0.0), F.least(F.lit(margin), (view - (right - left)) / 2, left, 1 - right))
    low, high = F.greatest(F.lit(half), right - half + safe), F.least(F.lit(1 - half), left + half - safe)
    rows = obs.withColumns(dict(_l=left, _lo=low, _hi=high, keeper_context=use["k"], post_context=use["g"]))
    issue = F.when(c("_l").isNull(), "no_observed_anchor").when(c("_lo") > c("_hi") + 1e-9, "cannot_fit")
    return rows.withColumns(dict(issue=issue, lo=F.when(issue.isNull(), r5("_lo")), hi=F.when(issue.isNull(), r5(F.greatest("_lo", "_hi"))))).drop("_l", "_lo", "_hi")


def framing_interval(records: DataFrame, view: float) -> DataFrame:
    """Allowed crop centre per record from ball, subject, payoff box and phase."""
    half = view / 2
    c = F.col
    early = c("phase").isin("setup", "contact")
    edge = F.when(early, min(0.05, view * 0.15)).otherwise(min(0.032, view * 0.09))
    wide = F.struct(F.lit(half).alias("lo"), F.lit(1 - half).alias("hi"))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    hold = pair(F.greatest(F.lit(half), c("g_x2") - half), F.least(F.lit(1 - half), c("g_x1") + half))
    boxed = c("g_x1").isNotNull() & (c("g_x2") - c("g_x1") <= view)
    blind = c("ball_x").isNull() | (~c("direct") & ~c("guided"))
    lo1, hi1 = F.least("ball_x", "px1"), F.greatest("ball_x", "px2")
    joint = c("px").isNotNull() & (early | (F.abs(c("ball_x") - c("px")) <= 0.13)) & (hi1 - lo1 + edge * 2 <= view)
    left, right = F.when(joint, lo1).otherwise(c("ball_x")), F.when(joint, hi1).otherwise(c("ball_x"))
    rows = records.withColumns(dict(_e=edge, _l=left, _r=right))
    low = F.greatest(F.lit(half), c("_r") + F.least(c("_e"), F.greatest(F.lit(0.0), 1 - c("_r"))) - half)
    high = F.least(F.lit(1 - half), c("_l") - F.least(c("_e"), F.greatest(F.lit(0.0), c("_l"))) + half)
    rows = rows.withColumns(dict(_a=low, _b=high))
    a = F.when(c("_a") > c("_b"), F.greatest(F.lit(half), c("_r") - half)).otherwise(c("_a"))
    b = F.when(c("_a") > c("_b"), F.least(F.lit(1 - half), c("_l") + half)).otherwise(c("_b"))
    rows = rows.withColumns(dict(_a=a, _b=b))
    ca = F.greatest("_a", F.greatest(F.lit(half), c("ball_x") - view * 0.25))
    cb = F.least("_b", F.least(F.lit(1 - half), c("ball_x") + view * 0.25))
    centred = (early | ((c("phase") == "payoff") & c("possession"))) & (ca <= cb)
    found = pair(F.when(centred, ca).otherwise(c("_a")), F.when(centred, cb).otherwise(c("_b")))
    box = F.when(boxed, hold).when(blind | (c("_a") > c("_b")), wide).otherwise(found)
    rows = rows.withColumn("_i", F.coalesce(box, wide))
    return rows.select(*records.columns, r5("_i.lo").alias("frame_lo"), r5("_i.hi").alias("frame_hi"))


def camera_target(records: DataFrame, view: float) -> DataFrame:
    """Camera target by phase: carrier and ball before release, the ball with a small lead after it, the last target when blind."""
    c = F.col
    clip = lambda x, lo, hi: F.least(hi if isinstance(hi, Column) else F.lit(hi), F.greatest(lo if isinstance(lo, Column) else F.lit(lo), x))
    early = c("phase").isin("setup", "contact")
    man = c("px").isNotNull()
    m = min(0.035, view * 0.11)
    left, right = F.least("ball_x", "px1"), F.greatest("ball_x", "px2")
    both = c("ball_x") * 0.72 + c("px") * 0.28 + clip(c("velocity") * 0.06, -0.012, 0.012)
    snug = F.when(right - left + 2 * m <= view, clip(both, right + m - view / 2, left - m + view / 2)).otherwise(both)
    fly = c("ball_x") + clip(c("velocity") * F.when(c("goal_mode"), 0.14).otherwise(0.10), -0.04, 0.04)
    raw = F.when(c("ball_x").isNull(), None).when(early & ~man, None).when(early, clip(snug, 0.0, 1.0)).otherwise(clip(fly, 0.0, 1.0))
    rows = records.withColumn("_raw", raw)
    held = F.last("_raw", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("target", r5(F.coalesce(held, F.lit(0.5)))).drop("_raw")


def project_keyframes(records: DataFrame, view: float, width: float = 1080, height: float = 1920) -> DataFrame:
    """Source coordinates in output pixels, edge clearances and the composition flag."""
    c = F.col
    left = c("camera_x") - view / 2
    px = lambda x: F.round(F.coalesce((c(x) - left) / view * width, F.lit(-320.0)) + 1e-9, 2)
    py = lambda y: F.round(F.coalesce(c(y) * height, F.lit(-320.0)) + 1e-9, 2)
    room = lambda a, b: r5(F.coalesce(F.least(c(a) - left, left + view - c(b)) / view, F.lit(-1.0)))
    mid = (F.least("ball_x", "px1") + F.greatest("ball_x", "px2")) / 2
    off = F.when(c("ball_x").isNotNull() & c("px1").isNotNull(), F.abs(mid - c("camera_x")) / (view / 2)).otherwise(1.0)
    rows = in_crop(records, view)
    safe = ~c("phase").isin("setup", "contact") | (c("joint_in") & (off <= 0.55) & (F.least(c("px1") - left, left + view - c("px2")) / view >= 0.055))
    return rows.select(
        *SCENE, "frame", px("px").alias("player_px"), px("ball_x").alias("ball_px"), py("ball_y").alias("ball_py"), room("px1", "px2").alias("player_room"),
        room("ball_x", "ball_x").alias("ball_room"), r5(off).alias("offset"), F.coalesce(safe, F.lit(False)).alias("composition_safe"))


def observation_conflicts(obs: DataFrame, expected: DataFrame) -> DataFrame:
    """Claimed touches far from the ball, and missing or repeated frame indexes of a scene."""
    c = F.col
    dx = F.greatest(F.lit(0.0), c("px1") - c("bx2"), c("bx1") - c("px2"))
    dy = F.greatest(F.lit(0.0), c("py1") - c("by2"), c("by1") - c("py2"))
    far = obs.where(((c("phase") == "contact") | c("situation").isin("release", "receive")) & (F.sqrt(dx * dx + dy * dy) > 0.1)).select(*SCENE, "frame", F.lit("touch_far_from_ball").alias("issue"))
    n = obs.groupBy(*SCENE, "frame").agg(F.count(F.lit(1)).alias("n"))
    both = expected.withColumn("_want", F.lit(1)).join(n, [*SCENE, "frame"], "full_outer")
    kind = F.when(c("n").isNull(), "missing_index").when(c("_want").isNull(), "unexpected_index").when(c("n") > 1, "repeated_index")
    return far.distinct().unionByName(both.select(*SCENE, "frame", kind.alias("issue")).where("issue IS NOT NULL"))


def guide_problems(guides: DataFrame) -> DataFrame:
    """Issues of a guide of at most six anchors ``struct(t, phase, text, x1, x2)`` held in one row."""
    g = F.col("guide")
    n = F.size(g)
    late = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), lambda i: F.coalesce(F.try_element_at(g, i)["t"] < F.try_element_at(g, i - 1)["t"], F.lit(False)))
    bad_box = F.exists(g, lambda a: F.coalesce((a["x1"] < 0) | (a["x2"] > 1000) | (a["x1"] >= a["x2"]), F.lit(False)))
    act = F.filter(g, lambda a: (a["phase"] != "reaction") & a["x1"].isNotNull())
    first, last = F.try_element_at(act, F.lit(1)), F.try_element_at(act, F.lit(-1))
    flat = (F.col("length_ms") >= 2_000) & (F.size(act) >= 3) & (last["t"] - first["t"] < 125) & F.exists(act, lambda a: F.abs(a["x1"] + a["x2"] - first["x1"] - first["x2"]) / 2000 > 0.1)
    code = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    codes = F.array_compact(F.array(
        code((n < 1) | (n > 6), "anchor_count"), code(F.exists(g, lambda a: (a["t"] < 0) | (a["t"] > F.col("length_ms"))) | late, "anchor_clock"),
        code(F.exists(g, lambda a: ~a["phase"].isin("setup", "contact", "flight", "payoff", "reaction")), "anchor_phase"),
        code(F.exists(g, lambda a: F.length(F.trim(a["text"])) < 8), "anchor_text"), code(bad_box, "anchor_box"), code(flat, "collapsed_clock")))
    return guides.withColumn("problems", F.array_join(codes, ","))


def attach_occlusions(obs: DataFrame, reviews: DataFrame, view: float) -> DataFrame:
    """Hidden-ball rows a review explains: seen on both sides within 1 s of one shot, corridor fits the crop."""
    c = F.col
    span = obs.join(reviews, SCENE).where(c("frame").between(c("before"), c("after")))
    mid = (c("frame") > c("before")) & (c("frame") < c("after"))
    left = F.least(F.when(~mid, c("bx1")), F.when(mid, c("px1")))
    right = F.greatest(F.when(~mid, c("bx2")), F.when(mid, c("px2")))
    g = span.groupBy(*SCENE, "before", "after").agg(
        F.count(F.when(~mid & c("bx1").isNotNull(), 1)).alias("ends"), (F.max("t_ms") - F.min("t_ms")).alias("gap"),
        F.count(F.when((c("frame") > c("before")) & c("cut"), 1)).alias("cuts"), F.count(F.when(mid, 1)).alias("n"),
        F.count(F.when(mid & c("bx1").isNull() & c("px1").isNotNull() & c("phase").isin("flight", "continuation", "contact"), 1)).alias("ok"), F.min(left).alias("left"), F.max(right).alias("right"))
    good = g.where((c("ends") == 2) & (c("gap") <= 1_000) & (c("cuts") == 0) & (c("n") > 0) & (c("n") == c("ok")) & (c("right") - c("left") <= view))
    return good.select(*SCENE, F.explode(F.sequence(c("before") + 1, c("after") - 1)).alias("frame"), r5("left").alias("left"), r5("right").alias("right")).distinct()


def greedy_ball(frames: DataFrame, balls: DataFrame) -> DataFrame:
    """Per-frame choice by confidence minus distance to the last choice. A shot is folded; frames hold few balls."""
    d = F.struct((-F.col("confidence")).alias("o"), "idx", "cx", "cy", "confidence", "pitch_support", "near")
    packs = with_shot(frames).select(*SHOT, "frame", "t_ms").join(
        balls.groupBy(*SCENE, "frame").agg(F.sort_array(F.collect_list(d)).alias("ds")), [*SCENE, "frame"], "left")
    item = F.struct("t_ms", "frame", "ds")
    out_t = "array<struct<frame:bigint,idx:bigint,cx:double,cy:double>>"
    init = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array().cast(out_t).alias("out"))

    def best(ds, score, ok):
        pool = F.filter(ds, ok)
        return F.try_element_at(F.sort_array(F.transform(pool, lambda b: F.struct((-score(b)).alias("s"), b["idx"].alias("idx"), b["cx"].alias("cx"), b["cy"].alias("cy"), b["confidence"].alias("conf")))), F.lit(1))

    def step(acc, i):
        dist = lambda b: F.sqrt(F.pow(b["cx"] - acc["x"], 2) + F.pow(b["cy"] - acc["y"], 2))
        fresh = best(i["ds"], lambda b: b["confidence"] + b["pitch_support"] * 0.48 - b["near"] * 0.52, lambda b: (b["pitch_support"] >= 0.10) | (b["near"] <= 0.11))
        near = best(i["ds"], lambda b: b["confidence"] - dist(b) * 5.5, lambda b: F.lit(True))
        fly = best(i["ds"], lambda b: b["confidence"] - dist(b) * 2.2, lambda b: (b["near"] >= 0.065) & (b["confidence"] >= 0.65))
        away = lambda p: F.sqrt(F.pow(p["cx"] - acc["x"], 2) + F.pow(p["cy"] - acc["y"], 2))
        rescue = fly.isNotNull() & (near["conf"] < 0.45) & (away(fly) <= 0.25)
        pick = F.when(acc["x"].isNull(), fresh).when(F.coalesce(rescue, F.lit(False)), fly).when(away(near) <= 0.22, near)
        row = F.struct(i["frame"].alias("frame"), pick["idx"].alias("idx"), pick["cx"].alias("cx"), pick["cy"].alias("cy"))
        return F.struct(F.coalesce(pick["cx"], acc["x"]).alias("x"), F.coalesce(pick["cy"], acc["y"]).alias("y"),
                        F.when(pick.isNotNull(), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return fold(packs, SHOT, item, init, step).select(*SHOT, F.explode("state.out").alias("o")).select(*SCENE, "o.frame", "o.idx")


def hold_pan_path(rows: DataFrame, look_ms: int = 850, persist_ms: int = 280, hold_ms: int = 550, min_pan: float = 0.032, speed: float = 0.075) -> DataFrame:
    """Tripod camera: hold, and pan once the safe interval has been left persistently.

    A shot is a short list of holds and pans. For a hold, the samples ahead are cut into runs on one side of the camera;
    the first run that lasts gives the pan, whose easing is computed for all its rows at once. Rows without bounds say
    nothing. Bounded scenes are walked sample by sample, many of them in one call.
    """
    bound = lambda c: F.col(c).cast("double").alias(c)
    rows = rows.select(*SCENE, "frame", "t_ms", F.coalesce("cut", F.lit(False)).alias("cut"), bound("lo"), bound("hi"), bound("target_x"))
    walk = functools.partial(tripod, look_ms=look_ms, persist_ms=persist_ms, hold_ms=hold_ms, min_pan=min_pan, speed=speed)
    return in_groups(rows, SCENE, ["t_ms"], walk, "match_id long, scene_id long, frame long, camera_x double")


def tracked_path(rows: DataFrame, speed: float = 0.32) -> DataFrame:
    """Velocity-limited follow inside reachable bounds, then twelve bounded smoothing passes.

    A shot is one bounded array: a fold from its end narrows the bounds to what stays reachable, a fold from its start
    moves the camera, and the smoothing transforms the array of positions.
    """
    clamp = lambda x, low, high: F.greatest(low, F.least(high, x))
    packs = with_shot(rows).groupBy(*SHOT).agg(F.sort_array(F.collect_list(F.struct("t_ms", "frame", F.col("lo").alias("low"), F.col("hi").alias("high"), "target_x"))).alias("seq"))

    def narrow(later, row):
        nxt = F.element_at(later, 1)
        reach = F.greatest(F.lit(1), nxt["t_ms"] - row["t_ms"]) * speed / 1000
        low, high = F.greatest(row["low"], nxt["low"] - reach), F.least(row["high"], nxt["high"] + reach)
        possible = F.coalesce(low <= high, F.lit(False))
        tight = F.struct(row["t_ms"].alias("t_ms"), row["frame"].alias("frame"), F.when(possible, low).otherwise(row["low"]).alias("low"), F.when(possible, high).otherwise(row["high"]).alias("high"), row["target_x"].alias("target_x"))
        return F.concat(F.array(F.when(F.size(later) > 0, tight).otherwise(row)), later)

    packs = packs.withColumn("seq", F.aggregate(F.reverse("seq"), F.filter("seq", lambda r: F.lit(False)), narrow))
    first = F.element_at("seq", 1)
    start = clamp(first["target_x"], first["low"], first["high"])
    init = F.struct(start.alias("x"), F.lit(0.0).alias("v"), first["t_ms"].alias("t"), F.array(start).alias("out"))

    def move(acc, row):
        dt = F.greatest(F.lit(0.001), (row["t_ms"] - acc["t"]) / 1000)
        wish = clamp((row["target_x"] - acc["x"]) * 2.5, F.lit(-speed), F.lit(speed))
        x = clamp(acc["x"] + clamp(wish, acc["v"] - dt * 0.7, acc["v"] + dt * 0.7) * dt, row["low"], row["high"])
        return F.struct(x.alias("x"), ((x - acc["x"]) / dt).alias("v"), row["t_ms"].alias("t"), F.concat(acc["out"], F.array(x)).alias("out"))

    walked = packs.withColumn("xs", F.aggregate(F.slice("seq", F.lit(2), F.size("seq")), init, move)["out"])

    def soften(xs, _):
        def one(x, i):
            around = (F.get(xs, i - 1) + x * 2 + F.get(xs, i + 1)) / 4
            return F.when((i == 0) | (i == F.size("seq") - 1), x).otherwise(clamp(around, F.get("seq", i)["low"], F.get("seq", i)["high"]))

        return F.transform(xs, one)

    smooth = walked.withColumn("xs", F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("xs"), soften))
    return smooth.select(*SCENE, F.explode(F.arrays_zip(F.col("seq.frame").alias("frame"), F.col("xs").alias("x"))).alias("o")).select(*SCENE, "o.frame", F.col("o.x").alias("camera_x"))


def smooth_path(records: DataFrame, half: float, ahead: int = 2, dead: float = 0.004, top_speed: float = 0.42) -> DataFrame:
    """Look-ahead blend, eased follow with a dead zone and speed cap, then a five-row kernel inside one shot."""
    rows = with_shot(records)
    owner = F.when(F.col("phase").isin("setup", "contact"), "carrier").otherwise("ball")
    rows = rows.withColumn("own", owner)
    w = by_time(SHOT)
    ahead_x = F.col("target_x")
    same = F.lit(True)
    for k in range(1, ahead + 1):
        same = same & F.coalesce(F.lead("own", k).over(w) == F.col("own"), F.lit(False))
        ahead_x = F.when(same, F.lead("target_x", k).over(w)).otherwise(ahead_x)
    rows = rows.withColumn("aim", F.col("target_x") * 0.92 + ahead_x * 0.08)
    item = F.struct("t_ms", "frame", "shot", "aim")
    init = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<frame:bigint,x:double>>").alias("out"))

    def step(acc, i):
        start = F.coalesce(acc["x"], i["aim"])
        gap = i["aim"] - start
        gap = F.when(F.abs(gap) < dead, 0.0).otherwise(gap)
        cap = F.greatest(F.lit(0.001), (i["t_ms"] - acc["t"]) / 1000) * top_speed
        move = gap * F.least(F.lit(0.32), F.greatest(F.lit(0.10), 0.10 + F.abs(gap) * 0.58))
        x = F.least(F.lit(1 - half), F.greatest(F.lit(half), start + F.least(cap, F.greatest(-cap, move))))
        return F.struct(x.alias("x"), i["t_ms"].alias("t"), F.concat(acc["out"], F.array(F.struct(i["frame"].alias("frame"), x.alias("x")))).alias("out"))

    walked = fold(rows, SHOT, item, init, step).select(*SHOT, F.explode("state.out").alias("o")).select(*SHOT, "o.frame", "o.x")
    f = Window.partitionBy(*SHOT).orderBy("frame")
    parts = [F.lag("x", 2).over(f), F.lag("x", 1).over(f), F.col("x"), F.lead("x", 1).over(f), F.lead("x", 2).over(f)]
    soft = sum((p * k for p, k in zip(parts[1:], (2, 3, 2, 1))), parts[0] * 1) / 9
    return walked.select(*SCENE, "frame", r5(F.coalesce(soft, F.col("x"))).alias("camera_x"))


def possession_lock(people: DataFrame, balls: DataFrame, view: float) -> DataFrame:
    """Locked carrier per frame with hysteresis: a track must win several frames in a row to gain or take the lock.

    Referees and people off the pitch never qualify; a frame without anyone keeps the lock and forgets who was winning.
    Without a ball, people are judged by their place in the picture. ``balls`` may have ``contact_done``: while it is
    false, the lock moves only to feet clearly closer to the ball. The first rule that applies names the winner of a
    frame and the wins it needs. The lock is a state machine over one bounded shot; many shots
    are walked in one call.
    """
    men = people.where("pitch_support >= 0.08 AND role <> 'referee' AND track_id IS NOT NULL").drop("t_ms", "cut")
    done = F.coalesce(F.col("contact_done"), F.lit(True)) if "contact_done" in balls.columns else F.lit(True)
    shots = with_shot(balls).select(*SHOT, "frame", "t_ms", "ball_x", "ball_y", done.alias("contact_done"))
    rows = shots.join(men.select(*SCENE, "frame", "track_id", "track_age", "confidence", "pitch_support", "cx", "cy", "x1", "x2", "y1", "y2"), [*SCENE, "frame"], "left")
    rows = rows.withColumns(dict(seen=F.col("track_id").isNotNull(), track_id=F.coalesce("track_id", F.lit(0)).cast("long")))
    walk = functools.partial(carriers, view=view)
    return in_groups(rows, SHOT, ["t_ms", "frame", "track_id", "cx", "y2"], walk, "match_id long, scene_id long, frame long, carrier_id long")


def annotation_cue(records: DataFrame, scenes: DataFrame) -> DataFrame:
    """First qualifying row of the annotation window and the blended confidence of its cue."""
    rows = records.join(scenes, SCENE).where(F.col("t_ms").between(F.col("from_ms"), F.col("to_ms")))
    ok = F.col("ball_x").isNotNull() & F.col("joint_fit") & (F.col("track_id") == F.col("subject"))
    g = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy(*SCENE, "to_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("k"), F.median(F.when(F.col("ok"), F.col("subject_confidence"))).alias("m"),
        F.min(F.when(F.col("ok"), F.struct("t_ms", "ball_confidence"))).alias("f"))
    blend = F.col("m") * 0.68 + F.col("k") / F.col("n") * 0.24 + F.least(F.lit(1.0), F.col("f.ball_confidence") / 0.45) * 0.08
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend))
    return g.where("k > 0").select(*SCENE, F.col("f.t_ms").alias("cue_ms"), r5(conf).alias("confidence"), F.when(conf >= 0.58, "arrow").otherwise("none").alias("style"),
                                   F.least(F.lit(2_400), F.greatest(F.lit(600), F.col("to_ms") - F.col("f.t_ms"))).alias("hold_ms"))


def support_players(players: DataFrame, passes: DataFrame, kits: DataFrame, limit: int = 2) -> DataFrame:
    """Up to two players in the kit of both pass ends at a sensible spacing. ``kits`` holds distances to both ends per player."""
    end = lambda who: players.select(*SCENE, "frame", F.col("track_id").alias(who), F.col("cx").alias(who + "_x"), F.col("y2").alias(who + "_y")).dropDuplicates([*SCENE, "frame", who])
    rows = players.join(passes, [*SCENE, "frame"]).join(end("from_id"), [*SCENE, "frame", "from_id"]).join(end("to_id"), [*SCENE, "frame", "to_id"]).join(kits, [*SCENE, "frame", "idx"])
    c = F.col
    gap = lambda who: F.sqrt(F.pow(c("cx") - c(who + "_x"), 2) + F.pow(c("y2") - c(who + "_y"), 2))
    space = F.least(gap("from_id"), gap("to_id"))
    ok = (
        ~c("track_id").isin(c("from_id"), c("to_id")) & (c("confidence") >= 0.48) & (c("pitch_support") >= 0.08) & (c("track_age") >= 2)
        & (c("ends_distance") <= 0.34) & (F.greatest("to_from", "to_to") <= 0.30) & space.between(0.045, 0.45))
    rank = Window.partitionBy(*SCENE, "frame").orderBy((c("to_from") + c("to_to")) / 2 - c("confidence") * 0.05, "idx")
    return rows.where(ok).withColumn("rn", F.row_number().over(rank)).where(c("rn") <= limit).select(*SCENE, "frame", "idx")


def drawable_passes(records: DataFrame, players: DataFrame, reach_ms: int = 5_000) -> DataFrame:
    """Rows of a scene in which a pass can be drawn: SCENE, t_ms, to_id, from_x, from_y, to_x, to_y.

    The row shows a controlled ball in frame with its carrier, and no cut follows within reach. The receiver, seen in the
    same frame, is the player who owns the ball at the next verified contact (away from the ball, with a steady carrier
    behind it), else the first player who later controls the ball in three rows on end. Scenes are bounded, so windows and
    joins inside one are.
    """
    owns = F.col("possession") & F.col("track_id").isNotNull() & (F.col("subject_confidence") >= 0.70)
    later = by_time().rangeBetween(1, reach_ms)
    rows = records.withColumns(dict(
        cut_ahead=F.coalesce(F.max(F.col("cut").cast("int")).over(later), F.lit(0)) > 0,
        owner=F.first(F.when((F.col("phase") == "contact") & owns, F.col("track_id")), ignorenulls=True).over(later),
        steady=F.count(F.when(F.col("possession"), 1)).over(Window.partitionBy(*SCENE, "track_id").orderBy("t_ms").rangeBetween(-500, 0)),
        three=F.lead("t_ms", 2).over(by_time()),
    ))
    hold = owns & F.col("direct")
    alike = hold
    for k in (1, 2):
        alike = alike & F.coalesce(F.lead(hold, k).over(by_time()) & (F.lead("track_id", k).over(by_time()) == F.col("track_id")), F.lit(False))
    rows = rows.withColumn("turns", alike)
    fit = rows.where("direct AND joint_fit AND possession AND subject_confidence >= 0.78 AND NOT cut_ahead AND track_id IS NOT NULL AND ball_x IS NOT NULL")
    anchors = fit.select(*SCENE, "frame", "t_ms", "track_id", "owner", "steady", F.col("ball_x").alias("from_x"), F.col("ball_y").alias("from_y"))
    runs = rows.where("turns").select(*SCENE, F.col("t_ms").alias("r_ms"), F.col("three").alias("r_end"), F.col("track_id").alias("to_id"))
    seen = players.where("track_id IS NOT NULL").select(*SCENE, "frame", F.col("track_id").alias("to_id"), "idx", F.col("cx").alias("to_x"), F.col("y2").alias("to_y"))
    first_seen = seen.groupBy(*SCENE, "frame", "to_id").agg(F.min(F.struct("idx", "to_x", "to_y")).alias("p"))
    both = anchors.join(first_seen, [*SCENE, "frame"]).where(F.col("to_id") != F.col("track_id"))
    apart = F.sqrt(F.pow(F.col("from_x") - F.col("p.to_x"), 2) + F.pow(F.col("from_y") - F.col("p.to_y"), 2))
    at_contact = both.where((F.col("to_id") == F.col("owner")) & (F.col("steady") >= 2) & (apart >= 0.045)).withColumn("way", F.lit(0))
    near = (F.col("r_ms") > F.col("t_ms")) & (F.col("r_end") <= F.col("t_ms") + reach_ms)
    by_run = both.join(runs, [*SCENE, "to_id"]).where(near).select(both.columns).distinct().withColumn("way", F.lit(1))
    best = at_contact.unionByName(by_run).groupBy(*SCENE, "t_ms", "from_x", "from_y").agg(F.min(F.struct("way", "p", "to_id")).alias("b"))
    return best.select(*SCENE, "t_ms", "b.to_id", "from_x", "from_y", F.col("b.p.to_x").alias("to_x"), F.col("b.p.to_y").alias("to_y"))


def pass_anchor(records: DataFrame, players: DataFrame, requests: DataFrame, reach_ms: int = 7_000) -> DataFrame:
    """The row of each requested scene in which its pass is drawn: SCENE, anchor_ms and the ends of the pass.

    The row nearest ``want_ms`` if a pass can be drawn there, else the latest drawable row before some contact of the
    scene (or the latest at all), at most ``reach_ms`` away.
    """
    wanted = records.join(requests.select(*SCENE, "want_ms"), SCENE)
    gap = F.abs(F.col("t_ms") - F.col("want_ms"))
    nearest = wanted.groupBy(*SCENE, "want_ms").agg(F.min_by("t_ms", F.struct(gap, "t_ms")).alias("near_ms"), F.max(F.when(F.col("phase") == "contact", F.col("t_ms"))).alias("touch_ms"))
    drawn = drawable_passes(records, players).join(nearest, SCENE)
    rank = F.struct((F.col("t_ms") == F.col("near_ms")).alias("a"), F.coalesce(F.col("touch_ms") > F.col("t_ms"), F.lit(False)).alias("b"), F.col("t_ms"))
    row = F.struct(F.col("t_ms").alias("anchor_ms"), "to_id", "from_x", "from_y", "to_x", "to_y", (F.col("t_ms") == F.col("near_ms")).alias("asked"), gap.alias("gap"))
    best = drawn.groupBy(*SCENE).agg(F.max_by(row, rank).alias("r"))
    return best.where(F.col("r.asked") | (F.col("r.gap") <= reach_ms)).select(*SCENE, *[F.col(f"r.{c}").alias(c) for c in ("anchor_ms", "to_id", "from_x", "from_y", "to_x", "to_y")])
