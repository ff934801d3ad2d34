"""Orientation stories against a sequential chooser, what a diagram draws, severities without a reference, and the hold that stands for a clip."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import comparison, diagram, matching, reports, scoring
from plumbline.plans import pose
from plumbline.sources import clips

SCHEMA = "clip_id long, frame_idx long, t_ms long, score_upright double, score_rotated double"


def one_by_one(rows):
    """The orientation of each (t_ms, upright, rotated), read in order."""
    known = lambda v: v is not None and not math.isnan(v)
    margins = [b - a if known(a) and known(b) else None for _, a, b in rows]
    mean = lambda vs: sum(vs) / len(vs) if vs else None
    smooth = [mean([m for (u, _, _), m in zip(rows, margins, strict=True) if m is not None and abs(u - t) <= 250]) for t, _, _ in rows]
    opening = mean([m for (t, _, _), m in zip(rows, smooth, strict=True) if t <= rows[0][0] + 500 and m is not None])
    state, since, out = opening is not None and opening > 0, None, []
    for (t, _, _), m in zip(rows, smooth, strict=True):
        if m is None or abs(m) <= 0.05 or (m > 0) == state:
            since = None
        elif since is None:
            since = t
        elif t - since >= 300:
            state, since = not state, None
        out.append(state)
    return out


def chosen(df):
    got = {}
    for r in matching.choose_orientations(df, ["clip_id"], "t_ms", "frame_idx", "score_upright", "score_rotated").orderBy("clip_id", "frame_idx").collect():
        got.setdefault(r.clip_id, []).append(r.rotated)
    return got


def test_six_stories(spark):
    seeds = spark.createDataFrame([(i, n, 7) for i, n in enumerate(clips.ORIENTATION_STORIES)], "clip_id long, case string, seed long")
    plain = chosen(clips.orientation_clips(seeds, noise=0.0))
    assert plain == {i: one_by_one([r[1:] for r in clips.orientation_story(n)]) for i, n in enumerate(clips.ORIENTATION_STORIES)}
    upright, inverted, misread, switched, gaps, uneven = plain.values()
    assert not any(upright) and all(inverted) and not any(misread)
    assert switched == [False] * 15 + [True] * 25
    assert gaps == [True] * 51 + [False] * 19
    assert not uneven[15] and uneven[-1]
    noisy = chosen(clips.orientation_clips(seeds))
    assert [r[0] for r in noisy.values()] == [r[0] for r in plain.values()] and noisy[3] == plain[3]


def test_orientation_of_odd_clips(spark):
    nan = math.nan
    rows = {1: [(0, None, None)], 2: [(0, nan, 0.9), (100, 0.5, nan)], 3: [(0, 0.5, 0.5)] * 3, 4: [(100 * i, 0.9, 0.2 if i % 7 else None) for i in range(30)] + [(3000 + 40 * i, 0.1, 0.8) for i in range(20)]}
    steps = lambda upright, rotated: [(100 * i, *pair) for i, pair in enumerate(zip(upright, rotated, strict=True))]
    rows[5] = steps([0.9] * 40, [0.9] * 10 + [0.99] * 30)
    rows[6] = steps([0.9] * 30 + [0.99] * 10, [0.99] * 30 + [0.9] * 10)
    rows[7] = steps([0.9] * 40, [0.91] * 40)
    df = spark.createDataFrame([(c, i, *r) for c, rs in rows.items() for i, r in enumerate(rs)], SCHEMA)
    got = chosen(df)
    assert got == {c: one_by_one(rs) for c, rs in rows.items()}
    assert got[5] == [False] * 13 + [True] * 27 and got[6] == [True] * 34 + [False] * 6 and all(got[7])
    assert chosen(df.limit(0)) == {}


def test_severity_without_a_reference(spark):
    row = spark.createDataFrame([(170.0, 150.0, 0.05, -0.15, None)], "a double, b double, c double, d double, e double")
    s = lambda f, c: scoring.tolerance_severity(f, F.col(c))
    got = row.select(s("hip_angle", "a"), s("hip_angle", "b"), s("banana", "c"), s("banana", "d"), s("head", "e"), s("leg_separation", "a")).first()
    assert list(got)[:3] == [0.0, 1.0, 0.0] and got[3] == pytest.approx(0.55) and got[4] is None and got[5] == 1.0


def frames(spark):
    """A hold's frame, the same without what it measures, and one outside a hold."""
    names = [*pose.BODY]
    places = {j: geo.point(F.lit(float(i)), F.lit(float(2 * i))) for i, j in enumerate(names)}
    gone = F.lit(None).cast("struct<x: double, y: double>")
    df = spark.createDataFrame([(1, 0, 0, 0, True), (1, 1, 33, 0, False), (1, 2, 66, -1, True)], "clip_id long, frame_idx long, t_ms long, hold_id int, valid boolean")
    df = df.withColumns({f: F.lit(v).cast("double") for f, v in {**dict.fromkeys(scoring.JUDGED), "hip_angle": 150.0, "knee_angle": 170.0, "body_angle": 12.0, "com_u": 0.1, "com_v": 0.5}.items()})
    body = F.struct(*(places[j].alias(j) if j != "left_elbow" else gone.alias(j) for j in names), geo.point(F.lit(10.0), F.lit(500.0)).alias("wrist_mid"), F.lit(200.0).alias("body_length"))
    return df.withColumns({"picture": body, "facing_sign": F.lit(1), "balance_zone": F.lit("over")})


def test_diagram_of_a_frame(spark):
    marked = scoring.frame_severities(frames(spark), None, scoring.Rules())
    held, blind, outside = diagram.diagram_frames(marked, F.lit(1080)).orderBy("frame_idx").collect()
    bones = {(b.start, b.end): (b.severity, b.band) for b in held.bones}
    assert ("left_shoulder", "left_elbow") not in bones and ("left_elbow", "left_wrist") not in bones
    assert bones["left_hip", "left_knee"] == (1.0, "bad") and bones["left_knee", "left_ankle"] == (0.0, "ok") and bones["right_elbow", "right_wrist"] == (None, "ok")
    assert [b for b in bones if b[0] == "nose"] == [("nose", "left_shoulder")] and len(held.joints) == len(pose.BODY) - 1
    assert held.stack_band == "warn" and (held.stack.x, held.stack.top, held.stack.bottom) == (10.0, 0.0, 1080.0)
    assert (held.com.x, held.com.y, held.com_floor.y) == (30.0, 400.0, 500.0) and held.in_hold and held.balance_zone == "over"
    for other in (blind, outside):
        assert {b.band for b in other.bones} == {"neutral"} and {j.severity for j in other.joints} == {None} and other.stack_band == "neutral"
    assert blind.in_hold and not outside.in_hold


def test_clip_stands_by_its_longest_scored_hold(spark):
    rows = [(1, 0, 0, 2000, 50.0, "side"), (1, 1, 3000, 5000, 90.0, "side"), (1, 2, 6000, 9000, None, "side"), (2, 0, 0, 900, 70.0, "not_side"), (3, 0, 0, 900, None, "unsure")]
    holds = spark.createDataFrame(rows, "clip_id long, hold_id int, start long, end long, score double, view string")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "clip_id long")
    got = {r.clip_id: tuple(r)[1:] for r in pose.analysed_clips(ids, holds).select("clip_id", "holds", "scored", "clip_hold", "clip_score", "side_score", "not_side_only").collect()}
    assert got == {1: (3, 2, 0, 50.0, 50.0, False), 2: (1, 1, 0, 70.0, None, True), 3: (1, 0, None, None, None, False), 4: (0, 0, None, None, None, False)}


def decided(spark, rows, groups=()):
    headline = spark.createDataFrame([(m, s, float(r), float(a), float(b)) for m, s, r, a, b in rows], "model string, setting string, rate double, low double, high double")
    parts = spark.createDataFrame([(m, g, float(r)) for m, g, r in groups], "model string, group string, rate double")
    return comparison.decision(headline, parts, "a", "b", "c").first()


def test_decision_between_models(spark):
    got = decided(spark, [("a", "recommended", 0.9, 0.85, 0.95), ("b", "recommended", 0.7, 0.6, 0.8), ("c", "recommended", 0.97, 0.9, 0.99), ("a", "common", 0.8, 0.7, 0.9), ("b", "common", 0.75, 0.65, 0.85)], [("a", "wrists", 0.5), ("a", "ankles", 0.9), ("b", "wrists", 0.59)])
    assert (got.choice, got.decisive, got.robust, got.train) == ("a", True, "same, intervals meet", True) and got.headroom == pytest.approx(0.07) and got.first_worst == 0.5
    got = decided(spark, [("a", "recommended", 0.9, 0.8, 0.95), ("b", "recommended", 0.85, 0.8, 0.9), ("a", "common", 0.5, 0.4, 0.55), ("b", "common", 0.8, 0.7, 0.9)], [("a", "wrists", 0.6)])
    assert (got.choice, got.overlap, got.decisive, got.robust, got.train, got.headroom) == ("b", True, False, "differs", False, None)
    got = decided(spark, [("a", "recommended", 0.6, 0.5, 0.65), ("b", "recommended", 0.9, 0.8, 1.0)])
    assert (got.choice, got.decisive, got.robust) == ("b", True, None)
    for rows in ([], [("a", "recommended", math.nan, math.nan, math.nan), ("b", "recommended", 0.5, 0.4, 0.6)]):
        got = decided(spark, rows)
        assert (got.choice, got.decisive, got.overlap) == (None, False, False)


def test_dataset_report(spark):
    schema = "clip_id long, error string, frames long, second_person_frames long, contact_frames long, dropped_frames long, scorable_frames long, seconds double, trainer_present boolean, longest_contact double, grip long"
    rows = [(1, None, 100, 50, 25, 10, 65, 4.0, True, 1.0, 7), (2, "", 100, 0, 25, 0, 75, 5.0, False, 2.0, 1), (3, "no file", 999, 999, 999, 999, 999, 9.0, True, 9.0, 9), (4, None, 0, 0, 0, 0, 0, 0.0, None, 0.0, 0)]
    clips_ = spark.createDataFrame(rows, schema)
    got = reports.dataset_report(clips_, ("grip",)).first()
    assert (got.clips, got.measured, got.failed, got.with_trainer, got.clean, got.frames, got.contact_frames, got.grip, got.seconds) == (4, 3, 1, 1, 2, 200, 50, 8, 9.0)
    assert got.pct_contact == 25.0 and got.pct_scorable == 70.0 and got.pct_clean == pytest.approx(200 / 3)
    assert [tuple(r) for r in reports.report_clips(clips_, 2).collect()] == [(2, "affected", 25.0, None), (1, "affected", 25.0, None), (3, "failed", None, "no file")]
    empty = reports.dataset_report(clips_.limit(0)).first()
    assert (empty.clips, empty.frames, empty.pct_contact, empty.pct_clean) == (0, 0, 0.0, 0.0) and reports.report_clips(clips_.limit(0)).collect() == []
