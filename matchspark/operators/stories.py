"""Scoring incidents, replay links and incident views: groupings whose order of arrival matters.

A row joins the first (or latest) group it is linked with, so groups depend on order. Links decide which rows can matter to
each other at all: rows are split into components over shared links first, and only a component, not a match, is walked in
start order. Components come from shared keys (a story, a run of contacts, a stretch of footage a replay looks back on), so
no pairs of linked rows are listed.
"""

from __future__ import annotations

import bisect
from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.scalar import SCORING, deferred, is_true, kept, reaction, replay, story
from matchspark.operators.scenes import in_groups, starts
from matchspark.operators.timeline import interval_join, islands, merge_intervals
from matchspark.session import cut_lineage

#: Contacts closer than this, in overlapping clips of one type, show the same action.
CONTACT_MS = 1_000
#: A replay may follow what it shows by this much, another clip of the same goal by less.
REPLAY_MS, GOAL_MS, RECENT_MS = 45_000, 8_000, 12_000

#: What the walks read of a row.
Line = namedtuple("Line", "event_type story_id start_ms end_ms contact_ms is_replay")
Goal = namedtuple("Goal", "match_id moment_id ordinal story_id start_ms end_ms shown_again only_replays doubtful can_stand")


def components(members: DataFrame, keys: list[str], row: str, edge: str) -> DataFrame:
    """(keys, row, component) of rows that share edges; the component is its smallest row.

    ``members`` has one line per row and edge. Labels travel over whole edges at once and then jump to the label of their
    label, so the number of rounds grows with the logarithm of the longest chain. Rows without a shared edge are absent.
    """
    shared = members.groupBy(*keys, edge).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    lines = cut_lineage(members.join(shared, [*keys, edge], "left_semi").select(*keys, row, edge).distinct())
    labels = lines.select(*keys, row).distinct().withColumn("component", F.col(row))
    while True:
        low = lines.join(labels, [*keys, row]).groupBy(*keys, edge).agg(F.min("component").alias("component"))
        step = lines.join(low, [*keys, edge]).groupBy(*keys, row).agg(F.min("component").alias("_label"))
        jump = step.select(*keys, F.col(row).alias("_label"), F.col("_label").alias("_next"))
        now = labels.join(step, [*keys, row]).join(jump, [*keys, "_label"])
        done = cut_lineage(now.select(*keys, row, F.least("_label", "_next").alias("component"), (F.least("_label", "_next") != F.col("component")).alias("_moved")))
        labels = done.drop("_moved")
        if not done.where("_moved").limit(1).count():
            return labels


def contact_runs(rows: DataFrame) -> DataFrame:
    """match_id, ordinal, edge: rows of one type whose contacts follow each other within CONTACT_MS."""
    timed = rows.where("contact_ms IS NOT NULL").select("match_id", "event_type", "ordinal", "contact_ms", (F.col("contact_ms") + CONTACT_MS).alias("_end"))
    runs = islands(timed, ["match_id", "event_type"], "contact_ms", "_end", ["ordinal"])
    return runs.select("match_id", "ordinal", F.xxhash64(F.lit("contact"), "event_type", "island").alias("edge"))


def lookbacks(rows: DataFrame) -> DataFrame:
    """match_id, ordinal, edge: replays that open a story, and the clips that end in the stretch before them."""
    first = rows.groupBy("match_id", "event_type", "story_id").agg(F.min(F.struct("start_ms", "ordinal", "is_replay")).alias("f")).where("f.is_replay")
    stretch = merge_intervals(first.select("match_id", "event_type", (F.col("f.start_ms") - REPLAY_MS).alias("_s"), (F.col("f.start_ms") + 1).alias("_e")), ["match_id", "event_type"], "_s", "_e")
    at = rows.select("match_id", "event_type", "ordinal", F.col("end_ms").alias("_p")).unionByName(rows.where("is_replay").select("match_id", "event_type", "ordinal", F.col("start_ms").alias("_p")))
    hit = interval_join(at.withColumn("_q", F.col("_p") + 1), stretch, ["match_id", "event_type"], ("_p", "_q"), ("_s", "_e"), REPLAY_MS)
    return hit.select("match_id", "ordinal", F.xxhash64(F.lit("back"), "event_type", "_s").alias("edge"))


class Seen:
    """What a walk over one component remembers: groups by story, by contact and by the end of a clip."""

    def __init__(self) -> None:
        self.stories: dict = {}
        self.contacts: dict = defaultdict(list)
        self.ends: dict = defaultdict(list)

    def same_contact(self, r) -> Iterator[int]:
        if pd.isna(r.contact_ms):
            return
        slot = int(r.contact_ms // CONTACT_MS)
        for near in (slot - 1, slot, slot + 1):
            for contact, start, end, group in self.contacts[r.event_type, near]:
                if abs(contact - r.contact_ms) < CONTACT_MS and min(end, r.end_ms) > max(start, r.start_ms):
                    yield group

    def before(self, r) -> int | None:
        """The latest group with a clip of this type that ended at most REPLAY_MS earlier."""
        ends = self.ends[r.event_type]
        near = ends[bisect.bisect_left(ends, (r.start_ms - REPLAY_MS, -1)):bisect.bisect_right(ends, (r.start_ms, float("inf")))]
        return max((g for _, g in near), default=None)

    def add(self, r, group: int) -> None:
        if not pd.isna(r.contact_ms):
            self.contacts[r.event_type, int(r.contact_ms // CONTACT_MS)].append((r.contact_ms, r.start_ms, r.end_ms, group))
        bisect.insort(self.ends[r.event_type], (r.end_ms, group))


def incident_of(r, at: int, seen: Seen) -> int:
    """The first group with the same story or contact; a replay without one joins the latest group shortly before it."""
    key = (r.event_type, r.story_id)
    linked = [*seen.same_contact(r), *([seen.stories[key]] if key in seen.stories else [])]
    back = seen.before(r) if not linked and r.is_replay else None
    group = min(linked) if linked else at if back is None else back
    seen.stories[key] = min(group, seen.stories.get(key, group))
    return group


def view_of(r, at: int, seen: Seen) -> int:
    """The first group with the same contact, else the group named after the row's story, else a new one of that name."""
    linked = min(seen.same_contact(r), default=None)
    return seen.stories.setdefault(r.story_id, at) if linked is None else linked


def first_groups(rows: DataFrame, edges: DataFrame, choose: Callable) -> DataFrame:
    """match_id, ordinal and ``first``, the ordinal of the first row of each row's group.

    ``choose(row, position, seen)`` names a group by the position of its first row. Rows that share no edge are groups of
    their own and never leave the JVM.
    """
    need = ["match_id", "ordinal", "event_type", "story_id", "start_ms", "end_ms", "contact_ms", "is_replay"]
    placed = rows.select(*need).join(components(edges, ["match_id"], "ordinal", "edge"), ["match_id", "ordinal"], "left")

    def walk(c: dict) -> tuple:
        first = np.empty(len(c["ordinal"]), np.int64)
        edges = [*starts(c["match_id"], c["component"]).tolist(), len(first)]
        lines = list(map(Line._make, zip(*(c[k].tolist() for k in Line._fields))))
        for a, b in zip(edges, edges[1:]):
            seen, group = Seen(), []
            for at, r in enumerate(lines[a:b]):
                group.append(choose(r, at, seen))
                seen.add(r, group[-1])
            first[a:b] = c["ordinal"][a:b][group]
        return c["match_id"], c["ordinal"], first

    alone = placed.where("component IS NULL").select("match_id", "ordinal", F.col("ordinal").alias("first"))
    many = in_groups(placed.where("component IS NOT NULL"), ["match_id", "component"], ["start_ms", "ordinal"], walk, "match_id long, ordinal long, first long")
    return alone.unionByName(many)


def scoring_incidents(obs: DataFrame) -> DataFrame:
    """``obs`` with ``incident_id``, the id of the first observation of its incident.

    In start order, an observation joins the first incident that has one of the same type with the same story, or with a
    contact within a second in an overlapping clip; a replay without such joins the latest incident of its type that has a
    clip ended at most 45 s before; all others open an incident. Needs match_id, moment_id, ordinal, story_id, event_type,
    start_ms, end_ms, contact_ms (may be null) and is_replay.
    """
    stories = obs.select("match_id", "ordinal", F.xxhash64(F.lit("story"), "event_type", "story_id").alias("edge"))
    groups = first_groups(obs, stories.unionByName(contact_runs(obs)).unionByName(lookbacks(obs)), incident_of)
    names = obs.select("match_id", F.col("ordinal").alias("first"), F.col("moment_id").alias("incident_id"))
    return obs.join(groups, ["match_id", "ordinal"]).join(names, ["match_id", "first"]).drop("first")


def scoring_coverage(obs: DataFrame, scenes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Incidents of ``obs`` and whether a selected scene keeps them, or a reviewed candidate corrects them.

    ``scenes`` are moments with contact_ms; ``candidates`` also have corrected_from, the scoring type that their verified
    outcome correction replaces (null: none). Of several corrections the first in input order counts.
    """
    sound = is_true("semantic_verified") & is_true("action_complete") & kept()
    views = cut_lineage(scoring_incidents(obs))
    able = scenes.where(sound & ~deferred() & F.col("event_type").isin(*SCORING))
    by_story = views.join(able.select("match_id", "event_type", "story_id").distinct(), ["match_id", "event_type", "story_id"], "left_semi").select("match_id", "incident_id")
    mine = views.where("contact_ms IS NOT NULL").select("match_id", "event_type", "incident_id", "start_ms", "end_ms", (F.col("contact_ms") - CONTACT_MS + 1).alias("_s"), (F.col("contact_ms") + CONTACT_MS).alias("_e"))
    theirs = able.where("contact_ms IS NOT NULL").select("match_id", "event_type", F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"), F.col("contact_ms").alias("_t"), (F.col("contact_ms") + 1).alias("_u"))
    near = interval_join(mine, theirs, ["match_id", "event_type"], ("_s", "_e"), ("_t", "_u"), 2 * CONTACT_MS)
    by_contact = near.where(F.least("end_ms", "o_end") > F.greatest("start_ms", "o_start")).select("match_id", "incident_id")
    retained = by_story.unionByName(by_contact).distinct().withColumn("retained", F.lit(True))
    fixes = candidates.where(sound & F.col("corrected_from").isNotNull()).groupBy("match_id", "story_id", F.col("corrected_from").alias("event_type")).agg(
        F.min(F.struct(F.col("ordinal").alias("o"), F.col("event_type").alias("to"))).alias("fix"))
    corrected = views.join(fixes, ["match_id", "story_id", "event_type"]).groupBy("match_id", "incident_id").agg(F.min("fix").alias("fix"))
    opened = F.min_by(F.struct("story_id", "event_type"), F.struct("start_ms", "ordinal"))
    incidents = views.groupBy("match_id", "incident_id").agg(opened.alias("v"), F.count(F.lit(1)).alias("observations"))
    both = incidents.join(retained, ["match_id", "incident_id"], "left").join(corrected, ["match_id", "incident_id"], "left")
    held = F.coalesce("retained", F.lit(False))
    return both.select(
        "match_id", "incident_id", "v.story_id", "v.event_type", "observations", (held | F.col("fix").isNotNull()).alias("covered"),
        F.when(held, "retained_scoring_action").when(F.col("fix").isNotNull(), "source_outcome_corrected").alias("resolution"), F.col("fix.to").alias("corrected_event_type"),
    )


def proven_goal():
    """A reviewed goal that was kept, or rejected for its crop only."""
    return is_true("semantic_verified") & (kept() | F.coalesce(F.col("tracking_decision") == "phase_verified_goal", F.lit(False)))


def linked_goals(c: dict) -> tuple:
    """The link of every goal of each run of goals to the latest live goal before it that it can show."""
    out = []
    live: list = []
    furthest: list = []  # latest end among the live goals up to each
    new = set(starts(c["match_id"], c["island"]).tolist())
    for i, r in enumerate(map(Goal._make, zip(*(c[k].tolist() for k in Goal._fields)))):
        if i in new:
            live, furthest = [], []
        reach = REPLAY_MS if r.shown_again else GOAL_MS
        target = None
        for at in range(len(live) - 1, -1, -1):
            if furthest[at] < r.start_ms - reach:
                break
            g = live[at]
            after = 0 <= r.start_ms - g.end_ms <= reach
            across = r.start_ms > g.start_ms and min(r.end_ms, g.end_ms) > max(r.start_ms, g.start_ms)
            if after or across:
                target = g
                break
        own, other = r.story_id, target.story_id if target else None
        fits = r.doubtful or (r.shown_again and (r.only_replays or r.start_ms - target.end_ms <= RECENT_MS)) if target else False
        if target and own != other and fits:
            out.append((r.match_id, r.moment_id, r.start_ms, r.ordinal, other, target.moment_id, other or target.moment_id, bool(r.only_replays)))
        elif r.can_stand:
            live.append(r)
            furthest.append(max(r.end_ms, furthest[-1] if furthest else r.end_ms))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
    return tuple(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))


def link_replays(moments: DataFrame) -> DataFrame:
    """``moments`` with replays of a verified live goal moved to its story; adds ``linked_id``, the goal's id.

    A goal is linked to the latest live goal that it overlaps or follows: a doubtful live claim within 8 s, a replay within
    45 s if its own story has no verified live goal, or within 12 s in any case. Linked goals are no live goals for later
    rows. Replays and reactions of a story that only had replays move along. Goals more than 45 s apart cannot meet, so
    runs of goals are walked, not matches.
    """
    key = story()
    goals = moments.where(F.col("event_type") == "goal")
    proven = goals.where(~replay() & proven_goal()).select("match_id", key.alias("_key")).distinct().withColumn("_live", F.lit(True))
    tagged = goals.withColumn("_key", key).join(proven, ["match_id", "_key"], "left").select(
        "match_id", "moment_id", "ordinal", "story_id", "start_ms", "end_ms", replay().alias("shown_again"),
        (replay() & F.col("_live").isNull()).alias("only_replays"),
        (~replay() & (~kept() | F.col("semantic_verified").eqNullSafe(F.lit(False)) | F.col("tracking_decision").eqNullSafe(F.lit("incomplete_goal_action")))).alias("doubtful"),
        (~is_true("is_replay") & proven_goal()).alias("can_stand"), (F.greatest("start_ms", "end_ms") + REPLAY_MS + 1).alias("_until"),
    )
    runs = islands(tagged, ["match_id"], "start_ms", "_until", ["ordinal"])
    # a goal alone in its run has none to be linked to
    several = runs.groupBy("match_id", "island").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    links = cut_lineage(in_groups(
        runs.drop("_until").join(several, ["match_id", "island"], "left_semi"), ["match_id", "island"], ["start_ms", "ordinal"], linked_goals,
        "match_id long, moment_id string, start_ms long, ordinal long, to_story string, linked_id string, to_key string, only_replays boolean"))
    own = moments.select("match_id", "moment_id", key.alias("_key"))
    moved = links.where("only_replays").join(own, ["match_id", "moment_id"]).groupBy("match_id", "_key").agg(F.max_by("to_key", F.struct("start_ms", "ordinal")).alias("_target"))
    hit = F.col("linked_id").isNotNull()
    first = moments.join(links.select("match_id", "moment_id", "to_story", "linked_id"), ["match_id", "moment_id"], "left").withColumns(dict(
        story_id=F.when(hit, F.col("to_story")).otherwise(F.col("story_id")), is_replay=F.when(hit, True).otherwise(F.col("is_replay")),
        story_phase=F.when(hit, "replay").otherwise(F.col("story_phase")))).drop("to_story")
    after = first.withColumn("_key", story()).join(moved, ["match_id", "_key"], "left")
    follows = F.col("_target").isNotNull() & (replay() | reaction())
    return after.withColumn("story_id", F.when(follows, F.col("_target")).otherwise(F.col("story_id"))).drop("_key", "_target")


def incident_views(moments: DataFrame) -> DataFrame:
    """One view per incident: match_id, moment_id, story_id, angle_selected, chosen_incident_angle.

    After ``link_replays``, verified complete actions group by contact (first group of the same type within a second, in an
    overlapping clip), else by story. Of a group the most readable, clearest, most complete, live, earliest view stays and
    names the story of all. A reaction stays right after its story's chosen goal (0.1 s before its end to 1 s after), up
    to the first celebration of the story. Needs readability and evidence_version besides the columns of moments.
    """
    linked = cut_lineage(link_replays(moments).withColumn("story_name", F.col("story_id")))
    able = linked.where(is_true("semantic_verified") & is_true("action_complete") & kept() & (F.col("evidence_version") == 2))
    actions = able.where(~reaction()).withColumns(dict(story_id=story(), is_replay=replay()))
    named = actions.select("match_id", "ordinal", F.xxhash64(F.lit("story"), "story_id").alias("edge"))
    groups = cut_lineage(first_groups(actions, named.unionByName(contact_runs(actions)), view_of))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    best = F.struct(-zero("readability"), -zero("visual_clarity"), -zero("completeness"), "is_replay", "start_ms", "ordinal")
    rows = actions.join(groups, ["match_id", "ordinal"])
    primary = rows.groupBy("match_id", "first").agg(F.min_by(F.struct("moment_id", "story_id", "event_type", "end_ms", "story_name"), best).alias("p"))
    placed = rows.join(primary, ["match_id", "first"]).select("match_id", "moment_id", F.col("p.story_id").alias("to_story"), (F.col("moment_id") == F.col("p.moment_id")).alias("chosen"))
    goal = primary.where("p.event_type = 'goal'").select(F.col("match_id").alias("g_match"), F.col("p.story_name").alias("g_story"), F.col("p.end_ms").alias("g_end"))
    support = able.where(reaction())
    while True:  # a chosen reaction that is itself labelled a goal lets others follow it
        right_after = (F.col("match_id") == F.col("g_match")) & F.col("story_name").eqNullSafe(F.col("g_story")) & F.col("start_ms").between(F.col("g_end") - 100, F.col("g_end") + 1000)
        follows = cut_lineage(support.join(goal, right_after, "left_semi"))
        more = follows.where("event_type = 'goal'").select(F.col("match_id").alias("g_match"), F.col("story_name").alias("g_story"), F.col("end_ms").alias("g_end")).distinct().exceptAll(goal.distinct())
        if not more.limit(1).count():
            break
        goal = cut_lineage(goal.unionByName(more).distinct())
    order = F.struct("start_ms", "ordinal")
    until = follows.where("event_type = 'celebration'").groupBy(F.col("match_id").alias("g_match"), F.col("story_name").alias("g_story")).agg(F.min(order).alias("until"))
    near = follows.join(until, (F.col("match_id") == F.col("g_match")) & F.col("story_name").eqNullSafe(F.col("g_story")), "left")
    beside = near.where(F.col("until").isNull() | (order <= F.col("until"))).select("match_id", "moment_id", F.lit(None).cast("string").alias("to_story"), F.lit(True).alias("chosen"))
    out = linked.join(placed.unionByName(beside), ["match_id", "moment_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return out.select(
        "match_id", "moment_id", F.coalesce("to_story", "story_name").alias("story_id"), F.col("chosen").alias("angle_selected"),
        (F.col("chosen") & F.col("event_type").isin(*SCORING)).alias("chosen_incident_angle"))
