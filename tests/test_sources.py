"""Sources and sinks: schemas, refusals, whole frames and replaced tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.sources import tables


def keypoints(spark, extra=()):
    rows = [("c", f, f * 33, j, float(f), 1.0, 0.9) for f in range(2) for j in tables.JOINTS] + list(extra)
    return spark.createDataFrame(rows, "clip_id string, frame_idx long, t_ms long, joint string, x double, y double, visibility double")


def test_keypoints_lose_nan_and_must_be_whole(spark, tmp_path):
    df = keypoints(spark).withColumn("x", F.when(F.col("joint") == "nose", F.lit(float("nan"))).otherwise(F.col("x")))
    df.write.parquet(str(tmp_path / "k"))
    read = tables.read_keypoints(spark, str(tmp_path / "k"))
    assert read.where("x is null").count() == 2
    df.drop("visibility").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks visibility"):
        tables.read_keypoints(spark, str(tmp_path / "bad"))


def test_frames_and_joint_rows_are_inverse(spark):
    frames = tables.whole_frames(keypoints(spark), ["clip_id"])
    assert frames.count() == 2
    long = tables.joint_rows(frames, ["clip_id", "frame_idx", "t_ms"])
    assert long.count() == 66 and long.where("x = frame_idx").count() == 66
    twice = keypoints(spark, [("c", 1, 33, "nose", 0.0, 0.0, 0.9)])
    with pytest.raises(Exception, match="holds a joint twice"):
        tables.whole_frames(twice, ["clip_id"]).select("t_ms").collect()


def test_people_rows_have_a_block_for_nobody(spark):
    df = spark.range(2).selectExpr("id as frame_idx", "case when id = 1 then array(map('nose', struct(1.0D as x, 2.0D as y, 0.5D as visibility))) end as people")
    long = tables.joint_rows(df, ["frame_idx"], people="people")
    got = {(r.frame_idx, r.person_idx): r.n for r in long.groupBy("frame_idx", "person_idx").agg(F.count("x").alias("n")).collect()}
    assert got == {(0, -1): 0, (1, 0): 1} and long.count() == 66


def test_detections_refuse_unclear_flags(spark, tmp_path):
    head = "frame_idx,t_ms,person_idx,joint,x,y,confidence,detected,rotated\n"
    (tmp_path / "a.csv").write_text(head + "0,0,0,nose,1.5,2.5,0.7,true,false\n1,33,,nose,,,,false,false\n")
    rows = tables.read_detections(spark, str(tmp_path / "a.csv")).orderBy("frame_idx").collect()
    assert rows[0].detected and rows[0].visibility == 0.7 and rows[1].x is None
    (tmp_path / "b.csv").write_text(head + "0,0,0,nose,1.5,2.5,0.7,perhaps,false\n")
    with pytest.raises(Exception, match="neither true nor false"):
        tables.read_detections(spark, str(tmp_path / "b.csv")).collect()


def test_tables_are_replaced_and_optional(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_optional(spark, path, tables.KEYPOINTS).count() == 0
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 2}
