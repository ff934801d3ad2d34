"""Inbox plans, catalogue upkeep, contact rules and single-frame readings."""

from pyspark.sql import functions as F

from plumbline.operators import ingest, people
from plumbline.streaming import readings


def test_inbox_is_told_apart_by_content(spark):
    inbox = spark.createDataFrame([("a.mp4", "1"), ("b.MP4", "2"), ("c.mp4", "2"), ("d (2).mp4", "3"), ("e.mp4", "4"), ("f.txt", "9"), ("g.mp4", "5")], "name string, clip_id string")
    catalogue = spark.createDataFrame([("1",), ("",), (None,)], "clip_id string")
    placed = spark.createDataFrame([("e.mp4", "other"), ("e (ingest 1).mp4", "x"), ("g.mp4", "5")], "name string, clip_id string")
    got = {r.name: (r.target, r.reason) for r in ingest.plan_inbox(inbox, catalogue, placed).collect()}
    assert got == {
        "a.mp4": (None, "already in the catalogue"), "b.MP4": ("b.MP4", ""), "c.mp4": (None, "identical to b.MP4 in this inbox"),
        "d (2).mp4": ("d take3.mp4", ""), "e.mp4": ("e (ingest 2).mp4", ""), "g.mp4": (None, "identical to g.mp4 in place"),
    }


def test_pending_work_and_skills(spark):
    wanted = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s1")], "clip_id string, settings string")
    done = spark.createDataFrame([("a", "s1"), ("b", "s0")], "clip_id string, settings string")
    assert {r.clip_id for r in ingest.pending(wanted, done, ["clip_id"], "settings").collect()} == {"b", "c"}
    catalogue = spark.createDataFrame([("a", "old"), ("b", "kept")], "clip_id string, skill string")
    got = ingest.overwrite_skill(catalogue, spark.createDataFrame([("a", "line")], "clip_id string, skill string"))
    assert {tuple(r) for r in got.collect()} == {("a", "line"), ("b", "kept")}
    assert spark.range(1).select(ingest.trainer_present(F.create_map(F.lit(2), F.lit(0)), F.lit(0)).alias("v")).first().v is False


def body(ankle_x=0.5, hip_x=0.5, seen=0.9):
    at = {"wrist": (0.5, 0.9), "shoulder": (0.5, 0.65), "hip": (hip_x, 0.4), "ankle": (ankle_x, 0.1)}
    return {f"{s}_{p}": F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(seen).alias("visibility")) for p, (x, y) in at.items() for s in ("left", "right")}


def test_readings_of_a_frame(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    red = F.lit(False)
    assert one(readings.is_up(body())) and one(readings.is_inverted(body())) and one(readings.is_line(body(), red))
    assert not one(readings.is_line(body(ankle_x=0.9), red)) and not one(readings.is_line(body(hip_x=0.7), red))
    assert not one(readings.is_up(body(seen=0.1))) and one(readings.hip_angle(body())) == 180.0


def test_framing(spark):
    def frame(f, person, n, x=0.5, tall=True):
        joints = [*readings.REQUIRED, "nose"][:n]
        return [(f, person, j, x, 0.2 + (0.6 if tall else 0.1) * i / 8, 0.9) for i, j in enumerate(joints)]

    rows = frame(1, 0, 9) + frame(2, 0, 9) + frame(2, 1, 7) + frame(3, 0, 9, x=0.01) + frame(4, 0, 9, tall=False) + [(5, 0, "nose", 0.5, 0.5, 0.1)] + frame(6, 0, 6)
    df = spark.createDataFrame(rows, "f int, person int, joint string, x double, y double, visibility double")
    got = {r.f: r.status for r in readings.framing(df, ["f"], "person").collect()}
    assert got == {1: "ok", 2: "multiplePeople", 3: "partlyOutOfFrame", 4: "tooSmall", 5: "noPerson", 6: "partlyOutOfFrame"}


def test_contact_rules(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    at = {"shoulder": 0, "elbow": 10, "wrist": 20, "hip": 30, "knee": 40, "ankle": 50}
    wide = spark.range(1).select(*(point(0, y if (s, p) != ("left", "wrist") else 90).alias(f"{s}_{p}") for s in ("left", "right") for p, y in at.items()))
    limits = wide.select("*", F.struct(*(F.lit(10.0).alias(b) for b in people.BONES)).alias("limits"))
    row = limits.select(people.bone_outlier("limits").alias("bone"), people.counterpart_outlier().alias("pair")).first()
    assert row.bone == "left_forearm" and row.pair == "left_forearm"
    athlete = spark.createDataFrame([(1, "left_wrist", 50.0, 50.0), (2, "left_wrist", 1.0, 50.0)], "f int, joint string, x double, y double").withColumns({"feet": point(0, 0), "head": point(0, 100)})
    others = spark.createDataFrame([(1, 52.0, 50.0), (2, 52.0, 50.0)], "f int, x double, y double")
    assert {r.f: r.mixed for r in people.mixed_skeleton(athlete, others, ["f"]).collect()} == {1: True, 2: False}
