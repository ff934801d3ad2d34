"""Readers, and operators that no query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import people, review
from plumbline.sources import tables


def test_replaced_table_keeps_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        tables.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_listing_and_appending(spark, tmp_path):
    for clip in ("a", "b"):
        (tmp_path / f"{clip}.mov").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert {r.clip_id for r in tables.list_clips(spark, str(tmp_path), "mov").collect()} == {"a", "b"}
    wanted = spark.createDataFrame([("b",), ("z",)], "clip_id string")
    assert [r.clip_id for r in tables.list_clips(spark, str(tmp_path), "mov", wanted).collect()] == ["b"]
    for n in (2, 3):
        tables.append_rows(spark.range(n), f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 5


def point(label, x=50.0, y=25.0, key="keypointlabels", kind="keypointlabels", **more):
    return {"type": kind, "value": {"x": x, "y": y, "width": 0.3, key: label, **more}} if kind else {"value": {"x": x, "y": y, key: label, **more}}


def test_exports_are_read_as_the_tool_nests_them(spark, tmp_path):
    choice = {"type": "choices", "from_name": "quality", "value": {"choices": ["Unsure "]}}
    tasks = [
        {"id": 1, "data": {"image": "/data/a_1.jpg"}, "annotations": [
            {"completed_by": {"email": "", "username": "eva"}, "updated_at": "2026-01-02", "result": [point(["Left Wrist"]), point("nose", key="label", kind="keypoint", occluded=True), point(["a", "b"], x="12.5", visible=0), {"type": "rectanglelabels", "value": {"x": 1, "y": 1, "labels": ["box"]}}]},
            {"completed_by": 7, "created_at": "2026-01-01", "result": [choice, point(["hip"]), point(["knee"], visibility=1), point(["toe"], x="left")]},
        ]},
        {"id": 2, "data": {"image": "", "path": "b_2.jpg"}, "annotations": [{"result": [point("ankle", key="labels", kind=""), {"value": {"choices": "clear"}}, None, 5]}, {"result": None}]},
        {"id": 3}, "no task",
    ]
    (tmp_path / "a.json").write_text(json.dumps(tasks))
    want = {
        ("/data/a_1.jpg", 0, "Left Wrist", 50.0, True, "eva", "2026-01-02"), ("/data/a_1.jpg", 0, "nose", 50.0, False, "eva", "2026-01-02"),
        ("/data/a_1.jpg", 0, "a", 12.5, False, "eva", "2026-01-02"), ("/data/a_1.jpg", 0, "b", 12.5, False, "eva", "2026-01-02"),
        ("/data/a_1.jpg", 1, "hip", 50.0, False, "", "2026-01-01"), ("/data/a_1.jpg", 1, "knee", 50.0, True, "", "2026-01-01"), ("b_2.jpg", 0, "ankle", 50.0, True, "", ""),
    }
    read = lambda: {(r.image, r.annotation, r.joint, r.x, r.visible, r.labeler, r.labeled_at) for r in tables.read_export(spark, str(tmp_path)).collect()}
    assert read() == want
    (tmp_path / "a.json").write_text(json.dumps({"tasks": tasks, "total": 3}))
    assert read() == want
    for bad in ('{"items": []}', "7", "no json"):
        (tmp_path / "a.json").write_text(bad)
        with pytest.raises(Exception, match="expected a list of tasks"):
            tables.read_export(spark, str(tmp_path)).collect()


def test_probes_become_metadata(spark):
    stream = {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": "1080", "avg_frame_rate": "30000/1001", "r_frame_rate": "60/1", "side_data_list": [{"type": "x"}, {"rotation": -90}]}
    good = {"streams": [{"codec_type": "audio"}, stream, {"codec_type": "video", "width": 1}], "format": {"duration": "12.5", "bit_rate": "2500499"}}
    rows = [("WhatsApp Video 2026-07-22 at 9.09.23 PM.mp4", json.dumps(good)), ("b.mov", json.dumps({"streams": []})), ("c.mov", "not json"), ("d.mov", None)]
    got = {r.filename: r for r in tables.probe_rows(spark.createDataFrame(rows, "filename string, probe string")).collect()}
    a = got[rows[0][0]]
    assert (a.width, a.height, a.rotation, a.display_width, a.display_height, a.codec, a.bitrate_kbps, a.duration_s, a.is_vfr) == (1920, 1080, -90, 1080, 1920, "hevc", 2500, 12.5, True)
    assert a.fps_avg == pytest.approx(29.97003) and a.fps_nominal == 60.0 and a.recorded_at == "2026-07-22T21:09:23"
    for name in ("b.mov", "c.mov", "d.mov"):
        assert [got[name][c] for c in ("width", "codec", "fps_avg", "is_vfr", "duration_s")] == [None] * 5 and got[name].recorded_at == ""


def test_holds_and_reference(spark, tmp_path):
    (tmp_path / "h.csv").write_text("clip_id,hold_id,score\na,1,2.5\na,x,3\nb,2,none\n")
    assert {tuple(r) for r in tables.read_hold_table(spark, f"{tmp_path}/h.csv", ["score"]).collect()} == {("a", 1, 2.5), ("b", 2, None)}
    marks = {"schema": "some-reference", "version": 1, "signs": "athlete"}
    leg = {"mean": 1.0, "sd": 0.5, "n": 7}

    def read(**document):
        (tmp_path / "r.json").write_text(json.dumps({**marks, "features": {"leg": leg}, **document}))
        return sorted(tuple(r) for r in tables.read_reference(spark, f"{tmp_path}/r.json", ["leg", "knee", "hip"]).collect())

    # a part of the features is enough, and an sd of 0 is one
    assert read() == [("leg", 1.0, 0.5, 7)]
    assert read(features={"leg": leg, "knee": {"mean": 1, "sd": 0, "n": 0}}) == [("knee", 1.0, 0.0, 0), ("leg", 1.0, 0.5, 7)]
    assert read(features={}) == []
    for told, document in {
        "schema is other": {"schema": "other"}, "version is 2": {"version": 2}, "signs is nothing": {"signs": None}, "features is no object": {"features": [1]}, "toe is not a scored": {"features": {"toe": leg}},
        "leg has no mean": {"features": {"leg": {**leg, "mean": "1"}}}, "leg has an sd below 0": {"features": {"leg": {**leg, "sd": -1}}}, "leg has no count": {"features": {"leg": {**leg, "n": 1.5}}}, "leg has no sd": {"features": {"leg": {"mean": 1, "n": 2}}},
    }.items():
        with pytest.raises(Exception, match=told):
            read(**document)
    rows = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a long, b double")
    assert {r[0] for r in tables.known(rows).select(tables.fixture_json("a", "b")).collect()} == {'{"a":1,"b":null}', '{"a":2,"b":0.5}'}


def test_a_body_seen_twice_loses_no_frame(spark):
    height = {"ankle": 50.0, "hip": 110.0, "shoulder": 150.0, "wrist": 200.0}
    parts = [f"{side}_{part}" for side in ("left", "right") for part in height]
    joints = [(1, 1, p, j, 10.0 + 2 * j.startswith("left"), height[j.split("_")[1]] + dy, 0.9 - p / 100) for p, dy in ((0, 0.0), (1, 0.5)) for j in parts]
    long = spark.createDataFrame(joints, "clip long, frame long, person long, joint string, x double, y double, visibility double")
    persons = people.people(long, ["clip", "frame", "person"])
    assert people.choose_athlete(persons, ["clip"], "frame", "person").first().person is None
    assert people.choose_athlete(persons, ["clip"], "frame", "person", long).first().person == 0


def test_order_of_a_catalogue(spark):
    rows = spark.createDataFrame([("2", "b"), ("1", "z"), ("2", "a")], "at string, name string")
    assert [r.name for r in review.catalogue_order(rows, "at", "name").collect()] == ["z", "a", "b"]
    assert rows.agg(review.median_finite(F.lit(float("nan")))).first()[0] is None


def test_errors_over_short_lengths_and_rounding_as_sql(spark):
    from plumbline.operators import matching
    from plumbline.plans.review_queries import binary_rounded

    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    row = spark.range(1).select(
        matching.normalised_error(at(0.0, 0.0), at(3.0, 4.0), F.lit(1e-12)).alias("short"), matching.normalised_error(at(0.0, 0.0), at(3.0, 4.0), F.lit(0.0)).alias("none"),
        F.lit(28.172349999999998).alias("half"), F.lit(-28.172349999999998).alias("below"), F.lit(1e15).alias("large"), F.lit(None).cast("double").alias("unknown"),
    )
    r = binary_rounded(row, "half", "below", "large", "unknown").first()
    assert r.short == 5.0 / 1e-12 and r.none is None
    assert (r.half, r.below, r.large, r.unknown) == (round(28.172349999999998 * 1e4) / 1e4, round(-28.172349999999998 * 1e4) / 1e4, 1e15, None)
