"""The pose operators against plain loops and known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import text
from plumbline.operators import kernels, people, runs, sampling, scoring, stats, timeops, upsert


def clips(spark, seed, n=300):
    r = random.Random(seed)
    rows = []
    for clip in ("a", "b", "c"):
        t = 0.0
        for i in range(n):
            t += r.choice([0.03, 0.034, 0.05, 0.1, 0.4])
            rows.append((clip, i, round(t, 3), r.uniform(0, 100), r.uniform(0, 100), r.random() < 0.7, r.random() < 0.02, r.random() < 0.6))
    return rows, spark.createDataFrame(rows, "clip string, i int, t double, x double, y double, ok boolean, ev boolean, h boolean")


def by_clip(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def loop_holds(series, min_hold, max_break):
    found, start, gap = [], None, None
    for k, r in enumerate(series):
        if r[7]:
            start, gap = k if start is None else start, None
        elif start is not None:
            if r[6]:
                found.append((start, k - 1))
                start = gap = None
            elif gap is None:
                gap = k
            elif r[2] - series[gap][2] > max_break:
                found.append((start, gap - 1))
                start = gap = None
    if start is not None:
        found.append((start, gap - 1 if gap is not None else len(series) - 1))
    return [(a, b) for a, b in found if series[b][2] - series[a][2] >= min_hold]


def test_hold_runs_equal_a_loop(spark):
    for seed in range(3):
        rows, df = clips(spark, seed)
        got = {(r.clip, r.i): r.hold_id for r in runs.hold_runs(df, ["clip"], "t", "i", "h", "ev", 0.3, 0.3).collect()}
        for clip, series in by_clip(rows).items():
            want = [-1] * len(series)
            for hold, (a, b) in enumerate(loop_holds(series, 0.3, 0.3)):
                want[a : b + 1] = [hold] * (b - a + 1)
            assert [got[clip, k] for k in range(len(series))] == want


def test_phases_equal_a_loop(spark):
    rows, df = clips(spark, 5)
    held = runs.hold_runs(df, ["clip"], "t", "i", "h", "ev", 0.3, 0.3).withColumns({"low": F.col("x") > 30, "up": F.col("y") > 70})
    got = {(r.clip, r.i): (r.hold_id, r.phase) for r in runs.phases(held, ["clip"], "t", "i", "ok", "low", "up", "low").collect()}
    for clip, series in by_clip(rows).items():
        phase, was, seen = "pre", False, False
        for k, r in enumerate(series):
            hold, told = got[clip, k]
            if not r[5]:
                assert told == ("hold" if hold >= 0 else "unknown")
                continue
            if hold >= 0:
                phase, seen = "hold", True
            elif was:
                phase = "exit"
            elif r[3] > 30 and r[4] > 70:
                phase, seen = "kickup", True
            elif not r[3] > 30:
                phase = "post" if seen else "pre"
            was = hold >= 0
            assert told == phase


def test_gap_fill_and_motion(spark):
    rows, df = clips(spark, 7)
    filled = {(r.clip, r.i): (r.x, r.filled) for r in timeops.fill_gaps(df, ["clip"], "t", "i", ["x"], "ok", 0.2).collect()}
    moved = {(r.clip, r.i): r.step for r in timeops.window_motion(df, ["clip"], "t", "x", "y", "ok", 2.0, 0.2).collect()}
    for clip, s in by_clip(rows).items():
        good = [k for k, r in enumerate(s) if r[5]]
        for k, r in enumerate(s):
            a, b = max((g for g in good if g < k), default=None), min((g for g in good if g > k), default=None)
            x, full = r[3], False
            if not r[5] and a is not None and b is not None and 0 < s[b][2] - s[a][2] <= 0.2:
                x, full = s[a][3] + (s[b][3] - s[a][3]) * (r[2] - s[a][2]) / (s[b][2] - s[a][2]), True
            assert filled[clip, k][1] == full and math.isclose(filled[clip, k][0], x, abs_tol=1e-9)
            e = max((j for j in range(len(s)) if s[j][2] <= r[2] - 0.2), default=None)
            want = None if e is None or not r[5] or not s[e][5] else math.hypot(r[3] - s[e][3], r[4] - s[e][4]) / 2
            assert (moved[clip, k] is None) == (want is None) and (want is None or math.isclose(moved[clip, k], want))


def test_speed_outliers_carry_the_last_kept_sample(spark):
    rows = [("a", i, float(i), x, 0.0, ok) for i, (x, ok) in enumerate([(0, True), (100, True), (1, True), (0, False), (2, True), (200, True)])]
    df = spark.createDataFrame([(c, i, t, float(x), y, ok) for c, i, t, x, y, ok in rows], "clip string, i int, t double, x double, y double, ok boolean")
    got = [r.kept for r in kernels.remove_speed_outliers(df, ["clip"], "t", "i", "x", "y", "ok", 1.0, 8.0).orderBy("i").collect()]
    assert got == [True, False, True, False, True, False]


def test_hysteresis_waits(spark):
    margins = [(0, -0.2), (100, 0.3), (200, 0.3), (300, 0.01), (400, 0.3), (600, 0.3), (700, 0.3), (800, -0.4)]
    df = spark.createDataFrame([("a", i, float(t), m, False) for i, (t, m) in enumerate(margins)], "clip string, i int, t double, m double, start boolean")
    got = [r.rotated for r in kernels.switch_with_hysteresis(df, ["clip"], "t", "i", "m", "start", 0.05, 300.0).orderBy("i").collect()]
    assert got == [False] * 6 + [True, True]


def test_short_segments_join_the_longer_neighbour(spark):
    labels = ["line"] * 20 + ["pike"] * 5 + ["line"] * 12 + ["unmeasured"] * 3 + ["tuck"] * 11
    df = spark.createDataFrame([("a", float(i * 100), x) for i, x in enumerate(labels)], "clip string, t double, shape string")
    got = [(r.shape, r.start, r.end) for r in runs.merge_short_segments(df, ["clip"], "t", "shape", 1000.0).orderBy("segment_id").collect()]
    assert got == [("line", 0.0, 3900.0), ("tuck", 4000.0, 5000.0)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def p(x, y):
    return geo.point(F.lit(float(x)), F.lit(float(y)))


def test_geometry(spark):
    assert one(spark, geo.angle_at(p(0, 0), p(1, 0), p(2, 0))) == pytest.approx(180)
    assert one(spark, geo.angle_at(p(0, 1), p(0, 0), p(1, 0))) == pytest.approx(90)
    assert one(spark, geo.angle_between(p(0, 0), p(1, 0))) is None
    assert one(spark, geo.side_mean(F.lit(None).cast("double"), F.lit(3.0))) == 3.0
    assert one(spark, geo.facing_sign(p(0, 0), p(0, 1), p(-1, 0))) == 1
    assert one(spark, geo.facing_sign(p(0, 0), p(0, 1), p(0, 0.5))) is None
    assert one(spark, geo.banana(p(0, 0), p(-0.2, 0.5), p(0, 1), p(-1, 0))) == pytest.approx(0.2)
    for angle in (0, 90, 180, 270, 33):
        q = geo.inverse_rotate_point(geo.rotate_point(p(3, 4), angle, F.lit(10.0), F.lit(20.0)), angle, F.lit(10.0), F.lit(20.0))
        assert one(spark, q["x"]) == pytest.approx(3) and one(spark, q["y"]) == pytest.approx(4)
    assert [one(spark, geo.balance_zone(F.lit(v))) for v in (-0.04, 0.0, 0.07)] == ["under", "ok", "over"]


def test_centre_of_mass_of_a_straight_body(spark):
    heights = {"wrist": 0.0, "elbow": 0.15, "shoulder": 0.3, "hip": 0.6, "knee": 0.8, "ankle": 1.0, "foot_index": 1.05}
    joints = {f"{s}_{j}": p(0, y) for j, y in heights.items() for s in ("left", "right")}
    com = geo.centre_of_mass({**joints, "nose": p(0, 0.2)})
    assert one(spark, com["complete"]) and one(spark, com["mass"]) == pytest.approx(1.0)
    assert 0.45 < one(spark, com["y"]) < 0.6
    missing = {k: (geo.point(F.lit(None).cast("double"), F.lit(None).cast("double")) if k.startswith("right") else v) for k, v in joints.items()}
    assert one(spark, geo.centre_of_mass({**missing, "nose": p(0, 0.2)})["y"]) == pytest.approx(one(spark, com["y"]))


def test_text(spark):
    assert one(spark, text.recorded_at(F.lit("WhatsApp Video 2026-07-22 at 7.09.23 PM (1).mp4"))) == "2026-07-22T19:09:23"
    assert one(spark, text.recorded_at(F.lit("2026-02-30 at 7.09.23 PM.mp4"))) == ""
    assert [one(spark, text.hold_key(F.lit(v))) for v in ("2.0", " 2 ", "x1 ")] == ["2", "2", "x1"]
    assert one(spark, text.take_name(F.lit("clip (2).mp4"))) == "clip take3.mp4"
    assert one(spark, text.segment_times(F.lit(1000), F.lit(1200))) == [1100]
    assert one(spark, text.segment_times(F.lit(0), F.lit(1000))) == [250, 500, 750]
    assert one(spark, text.append_note(F.lit("seen"), "wall")) == "seen; wall"
    assert one(spark, text.append_note(F.lit("Wall"), "wall")) == "Wall"
    assert one(spark, text.parse_frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    with pytest.raises(Exception, match="neither true nor false"):
        one(spark, text.strict_bool(F.lit("maybe"), "detected"))


def test_score_of_a_perfect_and_a_bent_hold(spark):
    rules = scoring.Rules()
    frames = [("a", h, float(i), True, 1.0, *([0.0] * 6), 180.0, 180.0, 0.0, 0.0, 180.0 - 20 * h, 180.0, 0.0, 10.0) for h in (0, 1) for i in range(6)]
    names = "off_shoulder off_hip off_knee off_ankle line_deviation body_angle shoulder_angle hip_angle banana com_forward elbow_angle knee_angle leg_separation head".split()
    df = spark.createDataFrame(frames, "clip string, hold int, t double, valid boolean, facing_sign double, " + ", ".join(f"{n} double" for n in names))
    ref = {f: (v, 0.0) for f, v in zip(names, frames[0][5:], strict=True)} | {"com_sway_sd": (0.0, 0.0), "hip_angle_sd": (0.0, 0.0)}
    got = {r.hold: r for r in scoring.score_holds(scoring.hold_values(df, ["clip", "hold"], "t", rules), ref, rules).collect()}
    assert got[0].score == 100.0
    assert got[1].score == pytest.approx(100 * (1 - 0.10 * 4 / 4), abs=0.05)
    assert got[1].top_faults[0].feature == "elbow_angle" and got[1].top_faults[0].z == -4.0


def test_votes_quotas_and_histograms(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None)], "k string, side string")
    assert {r.k: r.side for r in stats.vote(df, ["k"], "side").collect()} == {"a": "x", "b": None, "c": None}
    assert sampling.quotas(10) == [7, 2, 1] and sum(sampling.quotas(301)) == 301
    h = stats.histogram(spark.createDataFrame([(0.0,), (100.0,), (95.0,), (None,)], "p double"), "p")
    assert [r.n for r in h.orderBy("bucket").collect()] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]


def test_bootstrap_covers_the_ratio(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i % 40, int(r.random() < 0.3), 1) for i in range(4000)], "clip int, hit int, one int")
    row = stats.bootstrap_ratio(df, "clip", "hit", "one", [], samples=200).first()
    assert row.low < row.ratio < row.high and row.high - row.low < 0.1


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2"), (None, "c", "n3")], "id int, name string, note string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    once = upsert.merge_dimension(old, new, "id", ["name"], ["note"])
    got = {r.id: (r.name, r.note, r.missing) for r in once.collect()}
    assert got == {1: ("a", "n1", True), 2: ("B", "n2", False), 3: ("C", None, False), None: ("c", "n3", False)}
    twice = upsert.merge_dimension(once.drop("missing"), new, "id", ["name"], ["note"])
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}
    labels = upsert.import_labels(old.select("id", "name"), new, ["id"], ["name"])
    assert {r.id: r.change for r in labels.collect()} == {1: "kept", 2: "updated", 3: "added", None: "kept"}


def test_athlete_is_the_inverted_person_throughout(spark):
    rows = []
    for f in range(6):
        rows.append(("a", f, 0, 100.0 + f, 50.0, 90.0, 100.0, 0.9, True))
        rows.append(("a", f, 1, 300.0, 50.0, 20.0, 100.0, 0.9, False))
    df = spark.createDataFrame(rows, "clip string, frame int, person int, hip_x double, hip_y double, wrist_y double, length double, visibility double, inverted boolean")
    assert [r.person for r in people.choose_athlete(df, ["clip"], "frame", "person").orderBy("frame").collect()] == [0] * 6
