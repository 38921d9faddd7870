"""Extra actions, timing treatments, the short reel and the check of a chosen story.

Each fills a budget in an order of its own. Ranks come from running counts, budgets from running sums, so a match is never
walked as one list; only entries that a budget cannot rule out are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.operators.incidents import unique_evidence
from matchspark.operators.ledger import VERIFIED_DECISIONS, incident_coverage
from matchspark.operators.selection import scene_capacity
from matchspark.operators.timeline import block_of, fold, scan
from matchspark.session import cut_lineage

# Events that may fill a recap, and their priority.
EXTRA_EVENTS = ["save", "shot_on_target", "shot_off_target", "big_chance", "tackle", "free_kick", "normal_play", "assist", "dribble"]
EXTRA_PRIORITY = {"save": 5, "shot_on_target": 5, "big_chance": 4, "tackle": 3, "shot_off_target": 2}

#: Cell of the time axis in which coverage is resolved, and ranks summed at a time.
CELL_MS, RANKS = 1_000, 1_024


def descending_rank(rows: DataFrame, scores: list[Column], ties: list[str], block: Column, name: str = "rank") -> DataFrame:
    """Number the rows of each match from 1 by ``scores`` (high first), then ``ties``; ``block`` must not fall along that order."""
    keyed = rows.withColumns({f"_s{i}": -s for i, s in enumerate(scores)})
    counted = scan(keyed, ["match_id"], [*[f"_s{i}" for i in range(len(scores))], *ties], block, upto={name: ("count", F.lit(1))})
    return counted.drop(*[f"_s{i}" for i in range(len(scores))])


def first_cover(spans: DataFrame) -> DataFrame:
    """(match_id, rank, new_ms): how much of the union of all ``spans`` (match_id, rank, s, e) has ``rank`` as its lowest cover.

    Inside a cell, a clip covers everything, or all from its start, or all up to its end, or (a clip within one cell) a
    middle part. The first is a minimum per cell, the next two are running minima over the cell's cuts from either side;
    only clips within one cell meet the cuts between their ends.
    """
    span = spans.where("e > s").select("match_id", "rank", "s", "e", block_of(F.col("s"), CELL_MS).alias("b0"), block_of(F.col("e") - 1, CELL_MS).alias("b1"))
    span = cut_lineage(span)
    whole = span.where("b1 > b0 + 1").select("match_id", "rank", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)).alias("cell")).groupBy("match_id", "cell").agg(F.min("rank").alias("whole"))
    heads = span.where("b1 > b0").select("match_id", F.col("b0").alias("cell"), F.col("s").alias("at"), F.col("rank").alias("head"))
    tails = span.where("b1 > b0").select("match_id", F.col("b1").alias("cell"), F.col("e").alias("at"), F.col("rank").alias("tail"))
    inner = span.where("b1 = b0").select("match_id", F.col("b0").alias("cell"), "s", "e", "rank")
    cells = whole.select("match_id", "cell").unionByName(heads.select("match_id", "cell")).unionByName(tails.select("match_id", "cell")).unionByName(inner.select("match_id", "cell")).distinct()
    cuts = (
        cells.select("match_id", "cell", (F.col("cell") * CELL_MS).alias("at")).unionByName(heads, allowMissingColumns=True).unionByName(tails, allowMissingColumns=True)
        .unionByName(inner.select("match_id", "cell", F.col("s").alias("at")), allowMissingColumns=True).unionByName(inner.select("match_id", "cell", F.col("e").alias("at")), allowMissingColumns=True)
        .groupBy("match_id", "cell", "at").agg(F.min("head").alias("head"), F.min("tail").alias("tail"))
    )
    w = Window.partitionBy("match_id", "cell").orderBy("at")
    parts = cuts.select(
        "match_id", "cell", "at", F.coalesce(F.lead("at").over(w), (F.col("cell") + 1) * CELL_MS).alias("to"),
        F.min("head").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.min("tail").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("tail"),
    ).where("to > at")
    middle = parts.select("match_id", "cell", "at").join(inner, ["match_id", "cell"]).where("s <= at AND at < e").groupBy("match_id", "cell", "at").agg(F.min("rank").alias("middle"))
    least = parts.join(whole, ["match_id", "cell"], "left").join(middle, ["match_id", "cell", "at"], "left")
    return least.withColumn("rank", F.least("head", "tail", "whole", "middle")).where("rank IS NOT NULL").groupBy("match_id", "rank").agg(F.sum(F.col("to") - F.col("at")).alias("new_ms"))


def extra_actions(moments: DataFrame, most: int = 12, least_ms: int = 0) -> DataFrame:
    """match_id, moment_id, extra_selected and angle_deferred of every additional action.

    Ranked by priority of the event, clarity, importance and start, extras are taken until there are ``most`` of them and
    the footage, with the verified scenes that are no extras, covers ``least_ms``. Coverage along the ranks is the sum of
    what each rank is the first to cover, so a whole prefix needs no second look.
    """
    extra = S.is_true("additional_action")
    sound = S.is_true("semantic_verified") & S.kept()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shown = F.when(zero("visual_clarity") != 0, zero("visual_clarity")).otherwise(zero("importance"))
    able = moments.where(extra & S.is_true("angle_selected") & sound & S.is_true("action_complete") & F.col("event_type").isin(*EXTRA_EVENTS) & (shown >= 55))
    worth = S.lookup(EXTRA_PRIORITY, F.col("event_type"), 0)
    slim = able.select("match_id", "moment_id", "ordinal", "start_ms", "end_ms", worth.alias("worth"), zero("visual_clarity").alias("clear"), zero("importance").alias("weight"))
    block = -(F.col("worth") * 1000 + F.floor(F.greatest(F.lit(0.0), F.least(F.lit(999.0), F.col("clear"))))).cast("long")
    ranked = cut_lineage(descending_rank(slim, [F.col("worth"), F.col("clear"), F.col("weight")], ["start_ms", "ordinal"], block))
    base = moments.where(~F.coalesce(F.col("additional_action"), F.lit(False)) & sound & ~S.deferred()).select("match_id", F.lit(0).cast("long").alias("rank"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    gains = first_cover(base.unionByName(ranked.select("match_id", "rank", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))))
    steps = ranked.select("match_id", "rank").unionByName(base.select("match_id", "rank").distinct()).join(gains, ["match_id", "rank"], "left")
    before = scan(steps, ["match_id"], ["rank"], F.floor(F.col("rank") / RANKS), prior={"covered": ("sum", F.coalesce("new_ms", F.lit(0)))})
    taken = before.where((F.col("rank") > 0) & ((F.col("rank") <= most) | (F.coalesce("covered", F.lit(0)) < least_ms)))
    ids = ranked.join(taken.select("match_id", "rank"), ["match_id", "rank"]).select("match_id", "moment_id", F.lit(True).alias("extra_selected"))
    out = moments.where(extra).select("match_id", "moment_id").join(ids, ["match_id", "moment_id"], "left")
    return out.select("match_id", "moment_id", F.coalesce("extra_selected", F.lit(False)).alias("extra_selected")).withColumn("angle_deferred", ~F.col("extra_selected"))


# Events whose analysis may be slowed or frozen, and the limits of timing.
ANALYSED = ["goal", "shot_on_target", "shot_off_target", "big_chance", "save", "free_kick", "assist"]
SLOWEST, FASTEST, SCENE_MS, OVERRUN_MS = 0.72, 1.18, 30_000, 3_000


def limited_rate(rate: Column) -> Column:
    """A playback rate within its limits; none or 0 is normal speed."""
    return F.least(F.lit(FASTEST), F.greatest(F.lit(SLOWEST), F.when(F.coalesce(rate, F.lit(0.0)) == 0, 1.0).otherwise(rate)))


def whole_scene_rate(length: Column, wanted: float) -> Column:
    """``wanted``, or faster where the scene would outlast the longest scene."""
    return F.least(F.lit(FASTEST), F.greatest(F.lit(SLOWEST), F.lit(wanted), length / SCENE_MS))


def treatments(rows: DataFrame) -> DataFrame:
    """Add the gain of each stage that can treat a row (``gain_1`` .. ``gain_4``, ms; null: not treated) and what it sets."""
    d = S.length_ms().cast("double")
    shown = lambda rate: F.when(d > 0, F.least(F.lit(float(SCENE_MS)), d / rate)).otherwise(0.0)
    rate = limited_rate(F.col("playback_rate"))
    live = ~S.reaction() & ~S.replay() & F.col("event_type").isin(*ANALYSED) & ~S.is_true("compressed")
    frozen = F.coalesce(F.col("effect") == "freeze_analysis", F.lit(False))
    still = F.when(F.coalesce("freeze_ms", F.lit(0)) == 0, 650).otherwise(F.col("freeze_ms"))
    now = F.when(frozen & (d > 0), F.least(F.lit(1000), F.greatest(F.lit(400), still))).otherwise(0).cast("double")
    held = F.when(frozen, F.least(F.lit(1000), F.greatest(F.lit(800), F.coalesce("freeze_ms", F.lit(0))))).otherwise(800)
    one = F.when(live, F.least(rate, whole_scene_rate(d, 0.82))).otherwise(rate)
    three = F.when(~S.reaction(), F.least(one, whole_scene_rate(d, 0.72))).otherwise(one)
    four = F.least(rate, whole_scene_rate(d, 0.84))
    base = rows.withColumns(dict(_rate=rate, _r1=one, _r3=three, _r4=four, _held=held.cast("long"), _live=live, _now=now))
    return base.withColumns(dict(
        shown_ms=shown(F.col("_rate")) + F.col("_now"),
        gain_1=F.when(F.col("_live"), shown(F.col("_r1")) - shown(F.col("_rate"))),
        gain_2=F.when(F.col("_live"), F.when(d > 0, F.col("_held") - F.col("_now")).otherwise(0.0)),
        gain_3=F.when(~S.reaction(), shown(F.col("_r3")) - shown(F.col("_r1"))),
        gain_4=F.when(S.reaction(), shown(F.col("_r4")) - shown(F.col("_rate"))),
    ))


def expand_timeline(moments: DataFrame, target_ms: int) -> DataFrame:
    """Selected moments with edit_order, playback_rate, effect and freeze_ms after stretching the timeline towards ``target_ms``.

    Stages, each strongest first: analysed live actions to rate 0.82, then a freeze of 0.8 to 1 s on them, then all
    gameplay to 0.72 (replays last), then reactions in input order to 0.84. A step is taken while the timeline has never
    reached 96 % of the target (or all but 0.75 s); a reaction that would overrun the target by 3 s is left as it is.
    Steps of stages 1 to 3 are cut off by a running maximum of running sums. Reactions that alone cannot overrun, but come
    after enough others to fill the rest, drop out; of reactions of one gain only as many as fit stay; the rest is folded.
    ``compressed`` actions (and those that take their tracking from another) skip stages 1 and 2. Synthetic replays of an
    earlier edit are left out. edit_order becomes the place by edit_order (none: last), then start. Needs transition_ms; the
    first moment has none.
    """
    goal = max(target_ms * 0.96, target_ms - 750.0)
    rows = cut_lineage(treatments(moments.where("selected").where(~F.col("moment_id").endswith("--analysis-replay"))))
    cost = F.when(S.length_ms() > 0, F.least(F.lit(360.0), F.greatest(F.lit(40.0), F.when(F.coalesce("transition_ms", F.lit(0)) == 0, 40.0).otherwise(F.col("transition_ms").cast("double"))))).otherwise(0.0)
    opening = F.min_by(cost, F.col("ordinal"))  # the first moment is not cut to
    start = rows.groupBy("match_id").agg((F.sum(F.col("shown_ms") - cost) + opening).alias("from_ms"))
    weight = F.coalesce("importance", F.lit(0.0))
    steps = None
    for stage in (1, 2, 3):
        late = F.when(S.is_true("is_replay"), 1).otherwise(0) if stage == 3 else F.lit(0)
        part = rows.where(F.col(f"gain_{stage}").isNotNull()).select("match_id", "moment_id", "ordinal", F.lit(stage).alias("stage"), late.alias("late"), (-weight).alias("back"), F.col(f"gain_{stage}").alias("gain"))
        steps = part if steps is None else steps.unionByName(part)
    order = ["stage", "late", "back", "ordinal"]
    block = (F.col("stage") * 2 + F.col("late")) * 100_000 + F.floor(F.greatest(F.lit(-50_000.0), F.least(F.lit(49_999.0), F.col("back"))))
    summed = cut_lineage(scan(steps, ["match_id"], order, block, upto={"sum": ("sum", F.col("gain"))}).join(start, "match_id").withColumn("sum", F.col("from_ms") + F.col("sum")))
    peak = scan(summed, ["match_id"], order, block, prior={"peak": ("max", F.col("sum"))})
    taken = cut_lineage(peak.where(F.greatest("from_ms", F.coalesce("peak", F.col("from_ms"))) < goal).select("match_id", "moment_id", "stage", "gain"))
    reached = taken.groupBy("match_id").agg(F.sum("gain").alias("won"))
    stopped = summed.where(F.col("sum") >= goal).select("match_id").union(start.where(F.col("from_ms") >= goal).select("match_id")).distinct()
    left = start.join(stopped, "match_id", "left_anti").join(reached, "match_id", "left").select("match_id", (F.col("from_ms") + F.coalesce("won", F.lit(0.0))).alias("at_ms"))
    slow = slowed_reactions(rows.where("gain_4 > 0").join(left, "match_id"), goal, float(target_ms + OVERRUN_MS))
    marks = taken.groupBy("match_id", "moment_id").agg(*[F.bool_or(F.col("stage") == s).alias(f"t{s}") for s in (1, 2, 3)])
    out = rows.join(marks, ["match_id", "moment_id"], "left").join(slow, ["match_id", "moment_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rate = F.when(yes("t4"), F.col("_r4")).when(yes("t3") & (F.col("_r3") < F.when(yes("t1"), F.col("_r1")).otherwise(F.col("_rate"))), F.col("_r3")).when(yes("t1") & (F.col("_r1") < F.col("_rate")), F.col("_r1"))
    last = F.col("edit_order").isNull()
    placed = out.withColumns(dict(_late=last.cast("int"), _eo=F.coalesce("edit_order", F.lit(0))))
    turn = F.when(last, F.lit(1 << 40) + block_of(F.col("start_ms"), CELL_MS)).otherwise(F.col("edit_order").cast("long"))
    numbered = scan(placed, ["match_id"], ["_late", "_eo", "start_ms", "ordinal"], turn, prior={"place": ("count", F.lit(1))})
    return numbered.select(
        "match_id", "moment_id", F.coalesce("place", F.lit(0)).cast("long").alias("edit_order"), F.coalesce(rate, F.col("playback_rate")).alias("playback_rate"), F.when(yes("t2"), "freeze_analysis").otherwise(F.col("effect")).alias("effect"),
        F.when(yes("t2"), F.col("_held")).otherwise(F.col("freeze_ms")).alias("freeze_ms"))


def slowed_reactions(rows: DataFrame, goal: float, ceiling: float) -> DataFrame:
    """(match_id, moment_id, t4): reactions slowed in input order, from ``at_ms`` until ``goal``, none past ``ceiling``."""
    sure = F.when(F.col("gain_4") <= ceiling - goal, F.col("gain_4")).otherwise(0.0)
    before = scan(rows.select("match_id", "moment_id", "ordinal", "gain_4", "at_ms"), ["match_id"], ["ordinal"], F.floor(F.col("ordinal") / RANKS), prior={"sure": ("sum", sure)})
    open_ = before.where(F.col("at_ms") + F.coalesce("sure", F.lit(0.0)) < goal)
    alike = Window.partitionBy("match_id", "gain_4").orderBy("ordinal")
    fits = open_.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= F.floor((ceiling - F.col("at_ms")) / F.col("gain_4")) + 1)
    state = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<string>").alias("ids"))

    def step(acc, r):
        at = F.coalesce(acc["at"], r["at_ms"])
        ok = (at < goal) & (at + r["gain_4"] <= ceiling)
        return F.struct(F.when(ok, at + r["gain_4"]).otherwise(at).alias("at"), F.when(ok, F.concat(acc["ids"], F.array(r["moment_id"]))).otherwise(acc["ids"]).alias("ids"))

    done = fold(fits, ["match_id"], F.struct("ordinal", "moment_id", "gain_4", "at_ms"), state, step, "q")
    return done.select("match_id", F.explode("q.ids").alias("moment_id")).withColumn("t4", F.lit(True))


# Weights and lengths of the short reel.
REEL_WEIGHT = {"goal": 42, "disallowed_goal": 40, "save": 30, "shot_on_target": 24, "big_chance": 20}
REEL_LEAST_MS, REEL_MOST_MS = 30_000, 45_000
NOT_SHOWN = ["analysis_rejected", "not_tracked", "rejected_after_plan", "semantic_mismatch"]
STORY = ["match_id", "story"]


def reel_entries(moments: DataFrame) -> DataFrame:
    """The clips each story offers, in order: match_id, story, score, decision, action_start, place, moment_id, role, end_ms, shown_ms."""
    able = moments.where(S.is_true("semantic_verified") & S.kept() & ~F.coalesce(F.col("tracking_decision").isin(*NOT_SHOWN), F.lit(False)) & (S.length_ms() > 0))
    rows = cut_lineage(able.withColumn("story", S.story()).withColumns(dict(again=S.replay(), react=S.reaction(), decides=F.col("event_type").isin(*S.DECISIONS))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.count(F.when(F.col(c), 1))
    company = F.least(F.lit(12), count("again") * 6) + F.least(F.lit(8), count("react") * 4) + F.least(F.lit(10), count("decides") * 5)
    worth = S.lookup(REEL_WEIGHT, F.col("event_type"), 0) + zero("importance") * 0.20 + zero("hook") * 0.12 + zero("completeness") * 0.16 + zero("visual_clarity") * 0.12
    clip = F.struct("moment_id", "start_ms", "end_ms", "event_type")
    lead = F.col("event_type").isin(*REEL_WEIGHT) & ~F.col("again")
    told = rows.groupBy(*STORY).agg(
        company.alias("company"), F.bool_or("decides").alias("decision"), F.max(F.when(lead, F.round(worth, 6))).alias("worth"),
        F.min_by(clip, F.when(lead, F.struct(-F.round(worth, 6), "ordinal"))).alias("action"),
        F.min_by(clip, F.when(F.col("again"), F.struct(-zero("visual_clarity"), "start_ms", "ordinal"))).alias("repeat"),
    ).where("worth IS NOT NULL")
    story = told.select(*STORY, (F.col("worth") + F.col("company")).alias("score"), "decision", "action", "repeat")
    mine = rows.join(story.select(*STORY, F.col("action.moment_id").alias("a_id"), F.col("action.start_ms").alias("a_start")), STORY)
    built = mine.where((F.col("moment_id") != F.col("a_id")) & (F.col("story_phase") == "build_up") & (F.col("end_ms") <= F.col("a_start") + 250)).groupBy(*STORY).agg(F.min_by(clip, F.struct(-F.col("end_ms"), "ordinal")).alias("built"))
    two = Window.partitionBy(*STORY).orderBy("start_ms", "ordinal")
    pick = lambda cond, role: mine.where(cond).withColumn("n", F.row_number().over(two)).where("n <= 2").select(*STORY, clip.alias("clip"), F.lit(role).alias("role"), "n")
    pairs = pick(F.col("react"), "reaction").unionByName(pick(~F.col("react") & F.col("event_type").isin("var", "offside"), "decision"))
    one = lambda df, c, role: df.where(F.col(c).isNotNull()).select(*STORY, F.col(c).alias("clip"), F.lit(role).alias("role"), F.lit(0).alias("n"))
    clips = one(story, "action", "action").unionByName(one(story, "repeat", "replay")).unionByName(one(built, "built", "build_up")).unionByName(pairs)
    listed = clips.join(story, STORY)
    late = F.coalesce(F.col("clip.start_ms") >= F.col("repeat.start_ms"), F.lit(False))
    place = F.when(F.col("role") == "build_up", 0).when(F.col("role") == "action", 10).when((F.col("role") == "reaction") & ~late, 20).when(F.col("role") == "replay", 30).when(F.col("role") == "decision", 40).otherwise(50) + F.col("n")
    frozen = F.when((F.col("role") == "replay") & F.col("decision"), 720).when(F.col("role") == "action", 900).otherwise(0)
    pace = F.when(F.col("role") == "replay", 0.82).when(F.col("role") == "action", 0.72).otherwise(1.0)
    end = F.when(F.col("role") == "reaction", F.least(F.col("clip.end_ms"), F.col("clip.start_ms") + 7000)).otherwise(F.col("clip.end_ms"))
    natural = (F.col("clip.end_ms") - F.col("clip.start_ms")) / limited_rate(F.col("own_rate"))
    dressed = listed.withColumn("moment_id", F.col("clip.moment_id")).join(rows.select(*STORY, "moment_id", F.col("playback_rate").alias("own_rate")), [*STORY, "moment_id"])
    fit = dressed.where((F.col("role") != "build_up") | (natural >= 4000))
    timed = fit.select(
        *STORY, "score", "decision", F.col("action.start_ms").alias("action_start"), place.alias("place"), "moment_id", "role", end.alias("end_ms"),
        F.round((end - F.col("clip.start_ms")) / pace + frozen, 3).alias("shown_ms"))
    once = F.row_number().over(Window.partitionBy(*STORY, "moment_id").orderBy("place"))  # a clip keeps its first role
    return timed.withColumn("once", once).where("once = 1").drop("once")


def reel_plan(moments: DataFrame) -> DataFrame:
    """The clips of a reel of 30 to 45 s per match: match_id, story, moment_id, role, edit_order, end_ms, shown_ms.

    Stories by score (events, company of replays, reactions and decisions, editorial marks), each with a build-up of at
    least 4 s, its action, up to two reactions before and after its clearest replay, and decisions. A clip that would pass
    45 s is skipped, and no further story opens at 30 s. A story whose action lasts at most 15 s is always taken while the
    reel is under 30 s and lasts at least 0.9 s, so no story after the 34th such one is looked at; of clips of one length
    only as many as fit, and one more, can matter; the rest is folded. Needs hook besides the columns of moments; clips
    without length and stories without a live decisive action are left out. Ties go to the earlier start, then input order.
    """
    entries = cut_lineage(reel_entries(moments))
    story = entries.where("role = 'action'").select("match_id", "story", "score", "action_start", (F.col("shown_ms") <= REEL_MOST_MS - REEL_LEAST_MS).cast("int").alias("short"))
    block = -F.floor(F.col("score") * 4).cast("long")
    keyed = story.withColumn("back", -F.col("score"))
    ranked = scan(keyed, ["match_id"], ["back", "action_start", "story"], block, prior={"seen": ("sum", F.col("short"))}, upto={"turn": ("count", F.lit(1))})
    few = cut_lineage(ranked.where(F.coalesce("seen", F.lit(0)) < REEL_LEAST_MS // 900 + 1).select("match_id", "story", "turn"))
    near = entries.join(few, ["match_id", "story"])
    alike = Window.partitionBy("match_id", "shown_ms").orderBy("turn", "place")
    first = (F.col("turn") == 1) & F.col("role").isin("build_up", "action")
    fits = near.withColumn("n", F.row_number().over(alike)).where(first | ((F.col("shown_ms") <= REEL_MOST_MS) & (F.col("n") <= F.floor(F.lit(REEL_MOST_MS) / F.col("shown_ms")) + 2)))
    state = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("ids"))

    def step(acc, r):
        over = acc["full"] | ((acc["turn"] != r["turn"]) & (acc["total"] >= REEL_LEAST_MS))
        ok = ~over & ((F.size(acc["ids"]) == 0) | (acc["total"] + r["shown_ms"] <= REEL_MOST_MS))
        return F.struct(
            F.when(ok, acc["total"] + r["shown_ms"]).otherwise(acc["total"]).alias("total"), r["turn"].alias("turn"), over.alias("full"),
            F.when(ok, F.concat(acc["ids"], F.array(r["moment_id"]))).otherwise(acc["ids"]).alias("ids"))

    done = fold(fits, ["match_id"], F.struct("turn", "place", "moment_id", "shown_ms"), state, step, "q")
    chosen = done.select("match_id", F.posexplode("q.ids").alias("edit_order", "moment_id"))
    return entries.join(chosen, ["match_id", "moment_id"]).select("match_id", "story", "moment_id", "role", "edit_order", "end_ms", "shown_ms")


def story_check(plans: DataFrame, moments: DataFrame, least_ms: int = 0, most_ms: int | None = None) -> DataFrame:
    """Every plan with its violations, joined by commas (none: empty): plan_id, violations.

    ``plans`` has plan_id, match_id, position, moment_id and target_ms (one row per chosen moment; a plan without any has a
    null moment_id). Violations: ``candidates`` (none chosen, repeated or unknown), ``order`` (not in source order),
    ``coverage`` (a required incident of the match without a fitting chosen scene), ``unique`` (chosen passages overlap),
    ``duration`` (target unknown, under ``least_ms``, over ``most_ms`` or 10 ms over what the chosen scenes can fill).
    """
    picked = cut_lineage(plans.join(moments.withColumn("known", F.lit(True)), ["match_id", "moment_id"], "left"))
    keyed = picked.where("known").drop("selected").withColumn("selected", F.lit(True))
    per = lambda df: df.select("plan_id").distinct()
    all_plans = plans.groupBy("plan_id").agg(F.first("match_id").alias("match_id"), F.max("target_ms").alias("target_ms"))
    counts = picked.groupBy("plan_id").agg(F.count("moment_id").alias("n"), F.countDistinct("moment_id").alias("d"), F.count("known").alias("k"))
    bad_ids = per(counts.where("n = 0 OR d < n OR k < n"))
    by_place = scan(keyed, ["plan_id"], ["position"], F.floor(F.col("position") / RANKS), prior={"_last": ("last", F.col("start_ms"))})
    bad_order = per(by_place.where(F.col("start_ms") < F.col("_last")))
    # the rules on moments see a plan as a match of its own
    own = keyed.dropDuplicates(["plan_id", "moment_id"]).drop("match_id").withColumnRenamed("plan_id", "match_id")
    needs = incident_coverage(moments.withColumn("selected", F.lit(False))).select("match_id", F.col("story").alias("need"), F.col("kind").alias("need_kind"))
    required = all_plans.select("plan_id", "match_id").join(needs, "match_id")
    shown = plan_shows(own).withColumnRenamed("match_id", "plan_id")
    bad_cover = per(required.join(shown, ["plan_id", "need", "need_kind"], "left_anti"))
    left = cut_lineage(unique_evidence(own))
    kept = own.join(left, ["match_id", "moment_id"], "left_semi")
    bad_unique = per(own.join(left, ["match_id", "moment_id"], "left_anti").withColumnRenamed("match_id", "plan_id"))
    room = kept.groupBy(F.col("match_id").alias("plan_id")).agg(F.sum(scene_capacity()).alias("capacity"))
    over = F.lit(False) if most_ms is None else F.col("target_ms") > most_ms + 10
    target = all_plans.join(room, "plan_id", "left")
    bad_time = per(target.where(F.col("target_ms").isNull() | (F.col("target_ms") < least_ms) | over | (F.col("target_ms") > F.coalesce("capacity", F.lit(0.0)) + 10)))
    out, names = all_plans.select("plan_id"), ["candidates", "order", "coverage", "unique", "duration"]
    for name, bad in zip(names, (bad_ids, bad_order, bad_cover, bad_unique, bad_time)):
        out = out.join(bad.withColumn(name, F.lit(name)), "plan_id", "left")
    return out.select("plan_id", F.concat_ws(",", *names).alias("violations"))


def plan_shows(own: DataFrame) -> DataFrame:
    """(match_id, need, need_kind) of the stories that chosen scenes show, for every kind of incident a story may need."""
    shown = F.coalesce(F.col("tracking_decision").isin(*VERIFIED_DECISIONS), F.lit(False)) & S.is_true("semantic_verified") & S.kept()
    live = ~S.replay() | S.is_true("angle_selected")
    kinds = F.filter(F.array(
        F.when((F.col("event_type") == "goal") & S.is_true("action_complete") & live, "goal"), F.when((F.col("event_type") == "disallowed_goal") & S.is_true("action_complete"), "disallowed_goal"),
        F.when(F.col("event_type").isin("offside", "var") & S.not_false("action_complete") & S.not_false("tracking_passed"), "decision")), lambda x: x.isNotNull())
    return own.where(shown).select("match_id", S.story().alias("need"), F.explode(kinds).alias("need_kind")).distinct()
