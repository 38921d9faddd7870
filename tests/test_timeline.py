"""The time-axis helpers against brute force, with one match holding a third of all rows."""

import random

from pyspark.sql import functions as F

from matchspark.operators import timeline as T
from matchspark.operators.incidents import best_of_conflicts


def spans(n=240, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rnd.random() < 0.35 else rnd.randint(2, 9)
        start = rnd.randint(0, 200_000)
        rows.append((key, i, start, start + rnd.choice([0, 5, 900, 12_000, 70_000])))
    return rows


def table(spark, rows, prefix=""):
    return spark.createDataFrame(rows, f"match_id long, {prefix}id long, {prefix}s long, {prefix}e long")


def test_interval_join_reports_each_overlap_once(spark):
    a, b = spans(seed=1), spans(seed=2)
    got = T.interval_join(table(spark, a, "a"), table(spark, b, "b"), ["match_id"], ("as", "ae"), ("bs", "be"), 7_000).select("aid", "bid").collect()
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_scan_matches_plain_running_aggregates(spark):
    rows = sorted(spans(), key=lambda r: (r[2], r[1]))
    df = table(spark, rows)
    out = T.scan(
        df, ["match_id"], ["s", "id"], T.block_of(F.col("s"), 9_000),
        prior={"psum": ("sum", F.col("e")), "plast": ("last", F.when(F.col("id") % 3 == 0, F.col("id"))), "pfirst": ("first", F.col("id")), "pmax": ("max", F.col("e"))},
        upto={"n": ("count", F.lit(1))}, after={"nfirst": ("first", F.when(F.col("id") % 4 == 0, F.col("id"))), "nmin": ("min", F.col("e"))})
    for r in out.collect():
        same = [x for x in rows if x[0] == r.match_id]
        at = [x[1] for x in same].index(r.id)
        before, after = same[:at], same[at + 1:]
        assert r.psum == sum(x[3] for x in before) and r.n == at + 1
        assert r.pmax == max((x[3] for x in before), default=None)
        assert r.pfirst == (before[0][1] if before else None)
        assert r.plast == next((x[1] for x in reversed(before) if x[1] % 3 == 0), None)
        assert r.nfirst == next((x[1] for x in after if x[1] % 4 == 0), None)
        assert r.nmin == min((x[3] for x in after), default=None)


def test_merge_and_cover(spark):
    rows, windows = spans(seed=3), spans(seed=4)
    out = T.covered_by(table(spark, windows, "w"), table(spark, rows), ["match_id"], ("ws", "we"), ("s", "e"), ["wid"])
    for r in out.collect():
        seen = set()
        for x in rows:
            if x[0] == r.match_id:
                seen.update(range(max(x[2], r.ws), min(x[3], r.we)))
        assert r.covered_ms == len(seen)


def test_nearest_and_asof(spark):
    a, b = spans(seed=5), spans(seed=6)
    left = spark.createDataFrame([(k, i, s) for k, i, s, _ in a], "match_id long, id long, t long")
    right = spark.createDataFrame([(k, s, i) for k, i, s, _ in b], "match_id long, u long, rid long").dropDuplicates(["match_id", "u"])
    hits = {(r.match_id, r.u): r.rid for r in right.collect()}
    for r in T.nearest_within(left, right, ["match_id"], "t", "u", 4_000, ["rid"], 5_000).collect():
        near = min(((abs(u - r.t), u) for k, u in hits if k == r.match_id and abs(u - r.t) <= 4_000), default=None)
        assert r.near_ms == (near[1] if near else None)
    for side in ("before", "after"):
        for r in T.asof_within(left, right, ["match_id"], "t", "u", 4_000, ["rid"], side, 5_000).collect():
            us = [u for k, u in hits if k == r.match_id and (u <= r.t if side == "before" else u >= r.t) and abs(u - r.t) <= 4_000]
            want = (max(us) if side == "before" else min(us)) if us else None
            assert r[f"{side}_ms"] == want
            assert want is None or r[f"{side}_rid"] == hits[(r.match_id, want)]


def test_conflict_rounds_equal_the_greedy_walk(spark):
    rows = [r for r in spans(seed=8) if r[3] > r[2]]
    clash = lambda a, b: F.least(a("e"), b("e")) - F.greatest(a("s"), b("s")) >= F.least(a("e") - a("s"), b("e") - b("s")) * 0.5
    got = {r.id for r in best_of_conflicts(table(spark, rows), ["match_id"], [F.col("id")], "s", "e", clash, 10_000).collect()}
    kept = []
    for r in sorted(rows, key=lambda x: x[1]):
        clash = any(k[0] == r[0] and min(k[3], r[3]) - max(k[2], r[2]) >= min(k[3] - k[2], r[3] - r[2]) * 0.5 and min(k[3], r[3]) > max(k[2], r[2]) for k in kept)
        if not clash:
            kept.append(r)
    assert got == {r[1] for r in kept}
