"""Walks over many scenes in one call: the same as scene by scene, in few calls, and no group is split."""

import functools

import numpy as np
import pytest

from matchspark.operators import scenes as SC

KEYS = ("match_id", "scene_id")


def footage(each: int) -> dict:
    """``each`` rows a frame; scenes of 1 to 60 frames, some cut, some frames without anyone."""
    rng = np.random.default_rng(5)
    rows = [(m, s, f, i) for m in range(4) for s in range(12) for f in range(int(rng.integers(1, 60))) for i in range(each)]
    c = dict(zip((*KEYS, "frame", "idx"), (np.array(x) for x in zip(*rows))))
    n = len(rows)
    c["t_ms"] = c["frame"] * 100
    c["cut"] = (c["frame"] % 17 == 9) & (c["scene_id"] % 3 == 0)
    c["shot"] = np.where(c["scene_id"] % 3 == 0, (c["frame"] + 8) // 17, 0)
    c["track_id"] = (c["frame"] // 5 + c["idx"]) % 7
    c["track_age"] = c["frame"]
    c["seen"] = (c["frame"] % 11 != 3) | (c["idx"] == 0) & (c["frame"] % 2 == 0)
    c["contact_done"] = c["frame"] > 20
    c["route"] = c["frame"] % 4 == 0
    near = 0.1 + c["idx"] * 0.2 + c["frame"] * 0.004
    for k in ("cx", "cy", "y1", "confidence", "pitch_support", "kit", "price", "camera_x", "target_x", "lo"):
        c[k] = near + rng.normal(0, 0.02, n) if k in ("cx", "cy", "y1") else rng.random(n)
    c |= {"x1": c["cx"] - 0.02, "x2": c["cx"] + 0.02, "y2": c["y1"] + 0.1, "hi": c["lo"] + rng.random(n) * 0.5}
    c |= {"ball_x": np.where(c["frame"] % 5 == 2, np.nan, c["frame"] * 0.01), "ball_y": np.full(n, 0.5)}
    return c


WALKS = {
    "possession_lock": (functools.partial(SC.carriers, view=0.5), 4), "associate_people": (functools.partial(SC.tracks, ttl_ms=750), 4),
    "associate_ball": (functools.partial(SC.beam_search, beam=24, miss=2.5), 3), "simplify_path": (functools.partial(SC.control_points, tolerance=0.1), 1),
    "hold_pan_path": (functools.partial(SC.tripod, look_ms=850, persist_ms=280, hold_ms=550, min_pan=0.032, speed=0.075), 1),
}


def listed(out: tuple) -> list:
    return sorted(map(repr, zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in out))))


@pytest.mark.parametrize("name", WALKS)
def test_many_scenes_at_once_equal_scene_by_scene(name):
    walk, each = WALKS[name]
    c = footage(each)
    alone = []
    for m, s in sorted(set(zip(*(c[k].tolist() for k in KEYS)))):
        own = (c["match_id"] == m) & (c["scene_id"] == s)
        alone += listed(walk({k: x[own] for k, x in c.items()}))
    assert len(alone) > 500 or name == "simplify_path"
    assert listed(walk(c)) == sorted(alone)


def test_groups_reach_python_whole_and_many_at_once(spark):
    rows = spark.range(40_000).selectExpr("id % 2000 AS match_id", "id div 2000 AS t_ms")

    def walk(c):
        at = SC.starts(c["match_id"])
        size = np.diff(np.append(at, len(c["t_ms"])))
        return c["match_id"][at], size, np.full(len(at), len(at))

    got = SC.in_groups(rows, ["match_id"], ["t_ms"], walk, "match_id long, size long, together long").collect()
    assert len(got) == 2000 and {r.size for r in got} == {20} and min(r.together for r in got) > 50


def test_five_decimals_round_as_python_does():
    x = np.append(np.arange(0, 1, 0.000005), np.random.default_rng(1).random(20_000))
    assert SC.five_decimals(x).tolist() == [round(round(v, 5) * 1e5) for v in x.tolist()]
