"""Incidents, replay links, extras, reels and stored tables on small fixtures, against plain walks in order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from matchspark.operators import reels as R
from matchspark.operators import selection as SEL
from matchspark.operators import stories as S
from matchspark.session import ensure_checkpoint_dir
from matchspark.sources import readers

OBS = "match_id long, moment_id string, ordinal long, story_id string, event_type string, start_ms long, end_ms long, contact_ms long, is_replay boolean"


def walk_incidents(rows):
    groups, out = [], {}
    for r in sorted(rows, key=lambda r: (r[5], r[2])):
        _, mid, _, story, kind, a, b, contact, again = r
        same = lambda o: o[4] == kind and (o[3] == story or (None not in (contact, o[7]) and abs(contact - o[7]) < 1000 and min(b, o[6]) > max(a, o[5])))  # noqa: B023, E731
        group = next((g for g in groups if any(same(o) for o in g)), None)
        if group is None and again:
            group = next((g for g in reversed(groups) if any(o[4] == kind and 0 <= a - o[6] <= 45_000 for o in g)), None)
        if group is None:
            groups.append(group := [])
        group.append(r)
        out[mid] = group[0][1]
    return out


@pytest.mark.parametrize("span, stories", [(60_000, 500), (400_000, 40), (5_000_000, 3)])
def test_scoring_incidents_of_a_hot_match(spark, span, stories):
    """One match holds most rows; stories lie far apart; runs of replays chain."""
    rng = random.Random(span)
    rows = []
    for i in range(400):
        a = rng.randrange(span)
        contact = None if rng.random() < 0.2 else a + rng.randrange(9000)
        rows.append((1 if i % 10 else 2, f"m{i}", i, f"s{rng.randrange(stories)}", rng.choice(["goal", "disallowed_goal"]), a, a + rng.randrange(1, 9000), contact, rng.random() < 0.4))
    want = {}
    for match in (1, 2):
        want |= walk_incidents([r for r in rows if r[0] == match])
    got = S.scoring_incidents(spark.createDataFrame(rows, OBS).repartition(5))
    assert {r.moment_id: r.incident_id for r in got.collect()} == want


def test_a_story_far_apart_is_one_incident(spark):
    rows = [(1, "a", 1, "s", "goal", 0, 5000, 3000, False), (1, "b", 2, "t", "goal", 100_000, 105_000, 103_000, False), (1, "c", 3, "s", "goal", 4_000_000, 4_005_000, None, True), (1, "d", 4, "u", "goal", 4_010_000, 4_012_000, None, True)]
    got = {r.moment_id: r.incident_id for r in S.scoring_incidents(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "a"}
    assert S.scoring_incidents(spark.createDataFrame([], OBS)).count() == 0


LINK = "match_id long, moment_id string, ordinal long, story_id string, event_type string, start_ms long, end_ms long, is_replay boolean, story_phase string, keep_decision string, semantic_verified boolean, tracking_decision string"


def goal(mid, story, start, end, *, again=False, phase="action", keep="keep", verified=True, tracking=None, kind="goal"):
    return (1, mid, int(mid[1:]), story, kind, start, end, again, phase, keep, verified, tracking)


def linked(spark, *rows):
    return {r.moment_id: (r.story_id, r.is_replay, r.linked_id) for r in S.link_replays(spark.createDataFrame(list(rows), LINK)).collect()}


def test_replay_only_story_moves_with_its_reactions(spark):
    got = linked(spark, goal("m1", "live", 0, 10_000), goal("m2", "copy", 40_000, 44_000, again=True), goal("m3", "copy", 45_000, 47_000, kind="celebration", phase="reaction"), goal("m4", "copy", 48_000, 50_000, kind="save"))
    assert got["m2"] == ("live", True, "m1") and got["m3"][0] == "live" and got["m4"][0] == "copy"


def test_distances_of_links(spark):
    got = linked(
        spark, goal("m1", "a", 0, 10_000), goal("m2", "b", 17_000, 19_000, keep="reject"), goal("m3", "c", 20_000, 30_000), goal("m4", "a", 41_000, 43_000, again=True), goal("m5", "a", 60_000, 62_000, again=True), goal("m6", "x", 500_000, 501_000, keep="reject"))
    assert got["m2"] == ("a", True, "m1")  # a rejected claim within 8 s
    assert got["m3"] == ("c", False, None)  # a new live goal, however near
    assert got["m4"] == ("c", True, "m3")  # a replay within 12 s belongs to the newest goal
    assert got["m5"] == ("a", True, None) and got["m6"] == ("x", False, None)


def test_an_earlier_goal_may_qualify_when_the_latest_does_not(spark):
    got = linked(spark, goal("m1", "long", 0, 100_000), goal("m2", "short", 1_000, 2_000), goal("m3", "new", 110_000, 111_000, again=True))
    assert got["m3"] == ("long", True, "m1")


MOMENT = "match_id long, moment_id string, ordinal long, start_ms long, end_ms long, event_type string, visual_clarity double, importance double, additional_action boolean, angle_selected boolean, semantic_verified boolean, action_complete boolean, keep_decision string, angle_deferred boolean, support_deferred boolean"


@pytest.mark.parametrize("most, least_ms", [(0, 0), (3, 0), (2, 60_000), (1, 10**9)])
def test_extra_actions_by_covered_time(spark, most, least_ms):
    """One match holds nearly all rows; clips of a few ms, across cells and nested ones occur."""
    rng, rows = random.Random(most), []
    for i in range(240):
        a = rng.randrange(150_000)
        rows.append((1 if i % 12 else 2, f"m{i}", i, a, a + rng.choice([0, 7, 400, 999, 1000, 2500, 9000]), rng.choice(["save", "big_chance", "tackle", "assist"]), float(rng.choice([40, 55, 70, 90])), float(rng.randrange(3)), i % 3 > 0, True, True, True, "keep", False, False))
    got = {r.moment_id for r in R.extra_actions(spark.createDataFrame(rows, MOMENT), most, least_ms).where("extra_selected").collect()}
    want = set()
    for match in (1, 2):
        own = [r for r in rows if r[0] == match]
        covered = set()
        for r in own:
            if not r[8]:
                covered.update(range(r[3], r[4]))
        worth = {"save": 5, "big_chance": 4, "tackle": 3}
        n = 0
        for r in sorted((r for r in own if r[8] and r[6] >= 55), key=lambda r: (-worth.get(r[5], 0), -r[6], -r[7], r[3], r[2])):
            if n >= most and len(covered) >= least_ms:
                break
            n += 1
            want.add(r[1])
            covered.update(range(r[3], r[4]))
    assert got == want


def test_backups_of_matches_without_planned_scenes(spark):
    kind = "match_id long, moment_id string, story_id string, event_type string, story_phase string, description string, commentary string, analysis_purpose string, screen_text string, role string"
    rows = [(1, "a", "s", "goal", "action", "a low shot", None, "volley", None, None), (1, "b", "s", "goal", "action", "volley at the post", None, None, None, None), (2, "c", "s", "goal", "action", "volley", None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {r.moment_id: r.semantic_score for r in SEL.rank_backups(df.where("moment_id = 'a'"), df).collect()}
    assert got == {"a": 0, "b": 60 + 8 + 18, "c": 0}


def test_a_snapshot_is_visible_only_after_its_pointer(spark):
    path = f"{ensure_checkpoint_dir(spark)}/snap-{random.random()}"
    with pytest.raises(FileNotFoundError):
        readers.latest_snapshot(spark, path)
    readers.write_snapshot(spark.range(3), path, 1)
    spark.range(9).write.parquet(f"{path}/data/version=2")  # stopped before the pointer
    assert readers.latest_snapshot(spark, path).count() == 3
    readers.write_snapshot(spark.range(5), path, 2)
    readers.write_snapshot(spark.range(7), path, 2)  # published already
    readers.write_snapshot(spark.range(7), path, 1)
    assert readers.latest_snapshot(spark, path).count() == 5


def test_snapshots_of_micro_batches(spark):
    path = f"{ensure_checkpoint_dir(spark)}/snap-{random.random()}"
    publish = readers.snapshot_batches(path)
    for batch, n in ((0, 2), (1, 4), (1, 6)):
        publish(spark.range(n), batch)
    assert readers.latest_snapshot(spark, path).count() == 4


def test_an_upsert_leaves_other_partitions_alone(spark):
    path = f"{ensure_checkpoint_dir(spark)}/obs-{random.random()}"
    kind = "signature string, frame long, payload string, written_us long"
    readers.upsert_table(spark.createDataFrame([(f"s{i}", 1, "old", 1) for i in range(40)], kind), path, 8)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}

    before = files()
    readers.upsert_table(spark.createDataFrame([("s3", 1, "new", 2), ("s3", 2, "more", 2), ("s3", 1, "late", 0)], kind), path, 8)
    after = files()
    part = spark.read.parquet(path).where("signature = 's3'").first().part
    kept = {f for f in before if f"part={part}/" not in f}
    assert len(kept) > 3 and all(after.get(f) == before[f] for f in kept) and set(after) - set(before)
    rows = {(r.signature, r.frame): r.payload for r in spark.read.parquet(path).collect()}
    assert len(rows) == 41 and rows["s3", 1] == "new" and rows["s3", 2] == "more" and rows["s4", 1] == "old"
    assert spark.read.parquet(path).agg(F.count("*")).first()[0] == 41


def test_runs_of_goals_walked_in_one_call_do_not_see_each_other():
    import numpy as np

    c = {"match_id": np.array([1, 1, 1, 2, 2]), "island": np.array([1, 1, 2, 1, 1]), "moment_id": np.array(list("abcde"), object), "ordinal": np.arange(5), "story_id": np.array(["s", "t", "u", "v", None], object),
         "start_ms": np.array([0, 9_000, 12_000, 14_000, 20_000]), "end_ms": np.array([5_000, 11_000, 13_000, 15_000, 21_000]), "shown_again": np.array([False, True, True, True, True]),
         "only_replays": np.array([False, True, True, True, True]), "doubtful": np.zeros(5, bool), "can_stand": np.array([True, False, False, False, False])}
    out = S.linked_goals(c)
    assert [x.to_pylist() for x in out[1:2]] == [["b"]] and out[5].to_pylist() == ["a"] and out[4].to_pylist() == ["s"]


def test_components_walked_in_one_call_do_not_see_each_other(spark):
    rows = spark.range(400).selectExpr("id div 4 AS match_id", "id AS ordinal", "'goal' AS event_type", "concat('s', id % 2) AS story_id", "id % 4 * 1000 AS start_ms", "id % 4 * 1000 + 500 AS end_ms", "CAST(NULL AS BIGINT) AS contact_ms", "false AS is_replay")
    edges = rows.selectExpr("match_id", "ordinal", "xxhash64(story_id) AS edge")
    got = {r.ordinal: r.first for r in S.first_groups(rows, edges, S.view_of).collect()}
    assert got == {i: i - i % 4 + i % 2 for i in range(400)}
