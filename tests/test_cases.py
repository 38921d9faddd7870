"""Known input and output pairs."""

import pytest
from pyspark.sql import functions as F

from matchspark.functions import scalar as S
from matchspark.functions import text as TX
from matchspark.operators import quality as Q
from matchspark.operators import selection as SEL
from matchspark.operators import tracks as T
from matchspark.operators import windows as W


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.mark.parametrize("duration,last", [(529_107, (352_000, 177_107)), (538_000, (528_000, 10_000))])
def test_section_windows(spark, duration, last):
    src = one(spark, "match_id long, duration_ms long", (1, duration))
    got = [(r.start_ms, r.length_ms) for r in W.section_windows(src).orderBy("section").collect()]
    assert got[:2] == [(0, 180_000), (176_000, 180_000)] and got[-1] == last


def test_shot_inventory_numbers_by_input_position(spark):
    shots = one(spark, "match_id long, index long, shot_start_ms long, shot_end_ms long", (1, 1, 0, 6_000), (1, 2, 6_000, 6_100), (1, 3, 6_100, 14_000))
    src = one(spark, "match_id long, duration_ms long", (1, 14_000))
    assert sorted(r.shot_id for r in W.shot_inventory(shots, src).collect()) == ["shot-0001", "shot-0003"]


def test_chop_windows_cover_every_instant(spark):
    src = one(spark, "match_id long, duration_ms long", (1, 338_900))
    win = one(spark, "match_id long, start_ms long, end_ms long", (1, 39_600, 182_000), (1, 9_000, 8_000), (1, 5_000, 6_000))
    got = sorted((r.start_ms, r.end_ms) for r in W.chop_windows(win, src).collect())
    assert got[0][0] == 39_600 and got[-1][1] == 182_000 and all(b - a <= 42_000 for a, b in got)
    assert all(x[1] - y[0] >= 9_990 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("name,total", [("Final-Brentford-3-0-Chelsea-full", 3), ("x Chelsea-2-2-Hull-City.mp4", 4), ("match-2026-09-28", None)])
def test_goal_total_from_name(spark, name, total):
    assert one(spark, "n string", (name,)).select(TX.goal_total_from_name(F.col("n")).alias("g")).first().g == total


@pytest.mark.parametrize("raw,want", [("8", 80), ("9.5", 95), ("82", 82), (None, 45)])
def test_score_scale(spark, raw, want):
    assert one(spark, "v string", (raw,)).select(S.normalize_score_scale(F.col("v"), 45).alias("s")).first().s == want


FRAME = "match_id long, scene_id long, frame long, t_ms long, cut boolean, ball_x double, ball_y double"


def frames(spark, n, seen, cuts=()):
    return one(spark, FRAME, *[(1, 1, i, 100 * i, i in cuts, seen.get(i), 0.5 if i in seen else None) for i in range(n)])


def test_fill_gaps(spark):
    got = {r.frame: r.guide_x for r in T.fill_gaps(frames(spark, 5, {0: 0.2, 2: 0.3})).collect()}
    assert got == {1: 0.25}
    assert T.fill_gaps(frames(spark, 5, {0: 0.2, 2: 0.3}, {1})).count() == 0


def test_guidance_holds_the_edges(spark):
    got = {r.frame: r.guide_x for r in T.guidance(frames(spark, 8, {1: 0.2, 5: 0.5})).collect()}
    assert got[0] == 0.2 and got[3] == 0.35 and got[7] == 0.5


def test_contact_window_of_phase_quality(spark):
    rows = [(1, 1, t, "setup", t < 1000, True, True, False) for t in (800, 900, 1000, 1100, 1200)]
    k = one(spark, "match_id long, scene_id long, t_ms long, phase string, direct boolean, ball_in_frame boolean, joint_fit boolean, payoff_in_frame boolean", *rows)
    c = Q.phase_quality(k, F.lit(1000)).where("judged = 'contact'").first()
    assert (c.samples, c.direct_joint, c.payoff) == (5, 0.4, 0.0)


def test_scorer_is_the_player_at_the_ball(spark):
    players = one(
        spark, "match_id long, scene_id long, frame long, role string, track_id long, track_age long, cx double, x1 double, x2 double, y1 double, y2 double, pitch_support double, confidence double",
        (1, 1, 0, "player", 3, 5, 0.561, 0.54, 0.58, 0.5, 0.666, 0.5, 0.9), (1, 1, 0, "player", 39, 5, 0.642, 0.62, 0.66, 0.4, 0.582, 0.5, 0.9))
    records = one(spark, "match_id long, scene_id long, frame long, t_ms long, ball_x double, ball_y double, direct boolean, joint_fit boolean, track_id long, subject_confidence double, possession boolean",
                  (1, 1, 0, 1000, 0.656, 0.574, True, True, 3, 0.9, True))
    scenes = one(spark, "match_id long, scene_id long, contact_ms long", (1, 1, 1000))
    assert Q.scorer_track(players, records, scenes).first().scorer_id == 39


MOMENT = "match_id long, moment_id string, ordinal long, start_ms long, end_ms long, importance double, confidence double, duplicate_group string"


def brute_pack(rows, target):
    goal, used, out, seen = min(80_000, target), 0, set(), set()
    firsts = []
    for r in sorted(rows, key=lambda r: r[2]):
        if r[7] is None or r[7] not in seen:
            seen.add(r[7])
            firsts.append(r)
    for r in sorted((r for r in firsts if r[6] >= 0.5 and r[4] > r[3]), key=lambda r: (-r[5], r[3], r[2])):
        if used + r[4] - r[3] > goal + 250:
            continue
        out.add(r[1])
        used += r[4] - r[3]
        if used >= goal - 3_000:
            break
    return out


def test_pack_timeline_equals_the_greedy_walk_on_a_hot_match(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(3_000):
        s = rnd.randint(0, 5_000_000)
        rows.append((1, f"m{i}", i, s, s + rnd.choice([700, 2_000, 9_000, 31_000, 90_000]), float(rnd.randint(0, 30)), rnd.choice([0.4, 0.6, 0.9]), rnd.choice([None, None, "a", "b"])))
    got = {r.moment_id for r in SEL.pack_timeline(one(spark, MOMENT, *rows), 60_000).where("selected").collect()}
    assert got == brute_pack(rows, 60_000)


def test_weak_first_member_removes_its_group(spark):
    rows = [(1, "a", 0, 0, 5_000, 90.0, 0.4, "g"), (1, "b", 1, 0, 5_000, 80.0, 0.9, "g"), (1, "c", 2, 0, 5_000, 10.0, 0.9, None)]
    assert {r.moment_id for r in SEL.pack_timeline(one(spark, MOMENT, *rows), 60_000).where("selected").collect()} == {"c"}


def test_captions(spark):
    df = one(spark, "t string", ("One two three, four five six seven.",))
    assert df.select(TX.caption_chunks(F.col("t")).alias("c")).first().c == ["One two three,", "four five six", "seven."]
    assert df.select(TX.byte_chunks(F.lit("Go now. Then wait."), 8).alias("c")).first().c == ["Go now.", "Then", "wait."]


def test_wrong_reading_is_skipped_and_reversal_found(spark):
    from matchspark.operators import ledger as L

    rows = [(1, 1, 0, 0, 0, "01:00"), (1, 2, 10_000, 0, 0, "02:00"), (1, 3, 20_000, 1, 0, "03:00"), (1, 4, 30_000, 0, 0, "01:30"), (1, 5, 40_000, 1, 0, ""), (1, 6, 50_000, 0, 0, "04:00")]
    df = one(spark, "match_id long, sample_id long, t_ms long, home long, away long, clock string", *rows).withColumn("readable", F.lit(True))
    led = L.score_ledger(df, 5_400_000)
    a = L.ledger_anchors(led).collect()
    assert [(r.side, r.status, r.before_ms, r.after_ms) for r in a] == [("home", "reversed", 10_000, 20_000)]
    assert L.ledger_summary(led).first().complete


def test_associate_ball_ignores_a_confident_false_ball(spark):
    shot = one(spark, "match_id long, scene_id long, frame long, t_ms long, cut boolean", *[(1, 1, i, 100 * i, False) for i in range(8)])
    balls = [(1, 1, i, 0, 0.2 + 0.003 * i, 0.5, 0.5, 0.5, 0.05) for i in range(8)] + [(1, 1, i, 1, 0.8, 0.5, 0.8, 0.5, 0.05) for i in range(3)]
    df = one(spark, "match_id long, scene_id long, frame long, idx long, cx double, cy double, confidence double, pitch_support double, near double", *balls)
    got = T.associate_ball(shot, df).collect()
    assert len(got) == 8 and all(r.cx < 0.3 for r in got)


def test_associate_people_keeps_identity_and_restarts_at_a_cut(spark):
    shot = one(spark, "match_id long, scene_id long, frame long, t_ms long, cut boolean", *[(1, 1, i, 100 * i, i == 3) for i in range(5)])
    rows = [(1, 1, i, 100 * i, k, x + 0.01 * i, x + 0.01 * i - 0.02, 0.4, x + 0.01 * i + 0.02, 0.6, float(k)) for i in range(5) for k, x in enumerate((0.2, 0.7))]
    df = one(spark, "match_id long, scene_id long, frame long, t_ms long, idx long, cx double, x1 double, y1 double, x2 double, y2 double, kit double", *rows)
    got = {(r.frame, r.idx): (r.track_id, r.track_age) for r in T.associate_people(shot, df).collect()}
    assert got[(2, 0)] == (1, 3) and got[(2, 1)] == (2, 3) and got[(3, 0)] == (3, 1) and got[(4, 1)] == (4, 2)


def test_possession_lock_needs_three_wins_and_survives_empty_frames(spark):
    frames = one(spark, "match_id long, scene_id long, frame long, t_ms long, cut boolean, ball_x double, ball_y double", *[(1, 1, i, 100 * i, False, 0.3, 0.8) for i in range(9)])
    man = lambda i, k, x: (1, 1, i, k, 5, 0.9, 0.5, x, 0.7, x - 0.03, x + 0.03, 0.6, 0.8, "player")
    rows = [man(i, k, x) for i in (0, 1, 3, 4, 5, 8) for k, x in ((7, 0.3), (8, 0.7))]
    schema = "match_id long, scene_id long, frame long, track_id long, track_age long, confidence double, pitch_support double, cx double, cy double, x1 double, x2 double, y1 double, y2 double, role string"
    got = {r.frame: r.carrier_id for r in T.possession_lock(one(spark, schema, *rows), frames, 0.5).collect()}
    assert [got[i] for i in range(9)] == [None, None, None, None, None, 7, 7, 7, 7]  # frame 2 is empty, so the count starts anew


def test_simplify_path_keeps_corners(spark):
    k = one(spark, "match_id long, scene_id long, frame long, t_ms long, cut boolean, camera_x double", *[(1, 1, i, 100 * i, False, x) for i, x in enumerate([0.1, 0.2, 0.3, 0.2, 0.1])])
    assert sorted(r.frame for r in T.simplify_path(k, 0.02).collect()) == [0, 2, 4]


def test_subtitles_do_not_end_on_articles(spark):
    df = one(spark, "match_id long, beat_id string, length_ms long, narration string", (1, "b", 6_000, "The striker finds space behind the tired back line and rolls it in"))
    rows = TX.subtitle_chunks(df).orderBy("pos").collect()
    assert " ".join(r.line for r in rows) == "THE STRIKER FINDS SPACE BEHIND THE TIRED BACK LINE AND ROLLS IT IN"
    assert all(r.line.split()[-1] not in ("THE", "AND") for r in rows[:-1])
    assert rows[0].start_ms == 160 and rows[-1].end_ms == 5_880 and all(a.end_ms == b.start_ms for a, b in zip(rows, rows[1:]))


def test_folding_is_compatibility_decomposition(spark):
    """Every code point, alone and between letters, against Unicode's own tables."""
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from matchspark.functions import text as TX

    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(f"X{chr(c)}y",) for c in points] + [("\ufb01nale \u33a1 \U0001d400\U0001d41a \U0001f600 e\u0301 \u00bd",)]
    got = spark.createDataFrame(rows, "t string").select("t", F.regexp_replace(TX.fold_accents(F.col("t")), "[^a-z0-9]+", " ").alias("f")).collect()
    want = {t: re.sub("[^a-z0-9]+", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t.lower()))) for (t,) in rows}
    wrong = {r.t: (r.f, want[r.t]) for r in got if r.f != want[r.t]}
    assert len(wrong) < 12 and all(unicodedata.category(t[1]) in ("Lu", "Lt", "Lo", "Mn") for t in wrong), wrong  # newer letters whose case Java does not know yet


def test_parts_of_tracking_documents_are_joined_by_shuffles(spark, tmp_path):
    from matchspark.sources import readers as R

    spark.range(1000).selectExpr("""concat('{"moments":{"m', id, '":{"sampledFrames":1,"keyframes":[{"time":1}],"sourceRecords":[{"time":2}]}}}') AS doc""").write.parquet(f"{tmp_path}/docs")
    parts = R.parse_tracking(spark.read.parquet(f"{tmp_path}/docs"))
    both = parts["records"].select("moment_id", "n").join(parts["scene_evidence"].select("moment_id", "sampled_frames"), "moment_id").join(parts["keyframes"].select("moment_id", "t_ms"), "moment_id")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == 1000


def test_stable_score_takes_the_last_reading_before_and_the_first_after(spark):
    """Of readings at the same time, one counts on each side: the last before, the first after."""
    from matchspark.operators import ledger as L

    scene = "match_id long, moment_id string, start_ms long, end_ms long, contact_ms long, is_replay boolean, story_phase string"
    reading = "match_id long, ordinal long, t_ms long, clock_s long, home long, away long"
    for before, after, stable in (((0, 1), (1, 0), 1), ((1, 0), (1, 1), 0), ((0, 1), (0, 1), 0), ((1, 1), (1, 0), 1)):
        rows = [(1, 3 - i, 1_000, 1, h, 0) for i, h in enumerate(reversed(before))] + [(1, 5 - i, 9_000, 9, h, 0) for i, h in enumerate(reversed(after))]
        got = L.stable_score(one(spark, scene, (1, "a", 2_000, 8_000, None, False, "action")), one(spark, reading, *rows)).collect()
        assert [(r.before_ms, r.after_ms) for r in got] == [(1_000, 9_000)] * stable
