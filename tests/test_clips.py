"""Seeded clips: the data source and the columns draw the same, wherever the rows are made."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import pose
from plumbline.sources import clips


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def drawn(spark):
    spark.dataSource.register(clips.ClipSource)
    return spark.read.format("pose_clips").options(clips=7, seed=3, partitions=2).load().cache()


def test_partitions_do_not_change_the_rows(spark, drawn):
    whole = rows(drawn)
    for parts in (1, 7, 50):
        again = spark.read.format("pose_clips").options(clips=7, seed=3, partitions=parts).load()
        assert again.rdd.getNumPartitions() == min(parts, 7) and rows(again) == whole
    other = spark.read.format("pose_clips").options(clips=7, seed=4).load()
    assert rows(other) != whole
    assert spark.read.format("pose_clips").option("clips", 0).load().count() == 0
    with pytest.raises(Exception, match="partitions 1 or more"):
        spark.read.format("pose_clips").option("partitions", 0).load().count()


def test_columns_draw_what_the_source_does(spark, drawn):
    key = F.col("id")
    case = F.element_at(F.array(*map(F.lit, clips.NAMES)), (key % len(clips.NAMES) + 1).cast("int"))
    made = clips.clips(spark.range(7).select(key.alias("clip_id"), case.alias("case"), F.lit(3).alias("seed"), F.lit(1.0).alias("size")))
    keys = ["clip_id", "case", "frame_idx", "t_ms", "joint", "trainer_contact"]
    both = drawn.join(made.select(*keys, *(F.col(c).alias(f"{c}_") for c in ("x", "y", "visibility"))), keys)
    assert both.count() == drawn.count() == made.count()
    differ = [~F.col(c).eqNullSafe(F.col(f"{c}_")) & ~(F.abs(F.col(c) - F.col(f"{c}_")) <= 1e-6) for c in ("x", "y", "visibility")]
    assert both.where(differ[0] | differ[1] | differ[2]).count() == 0


def test_failures_are_where_the_story_says(drawn):
    by = drawn.groupBy("clip_id", "case").agg(
        F.countDistinct(F.when(F.col("x").isNull(), F.col("frame_idx"))).alias("gone"), F.countDistinct(F.when(F.col("visibility") == 0.1, F.col("frame_idx"))).alias("dim"),
        F.countDistinct(F.when(F.col("trainer_contact"), F.col("frame_idx"))).alias("touched"),
    )
    for r in by.collect():
        assert (r.gone, r.dim, r.touched) == ((7, 4, 0) if r.case == "gaps_and_noise" else (0, 0, 7) if r.case == "trainer_contact" else (0, 0, 0))
    ankle = {r.frame_idx: r.x for r in drawn.where("clip_id = 3 and joint = 'left_ankle' and x is not null").collect()}
    spikes = [f for f in ankle if f - 1 in ankle and f + 1 in ankle and ankle[f] - (ankle[f - 1] + ankle[f + 1]) / 2 > 150]
    assert len(spikes) == 1


def test_every_sample_is_accounted_for(spark, drawn):
    short = spark.createDataFrame([(99, "none", f, 33 * f, j, 1.0, 1.0, 0.9 if f else 0.1, False) for f in range(4) for j in clips.JOINTS], clips.SCHEMA)
    counts = {r.clip_id: r for r in pose.clean_counts(pose.clean(drawn.unionByName(short))).collect()}
    for r in counts.values():
        assert r.samples == r.measured + r.filled + r.gated_out + r.outliers + r.unusable
        assert 0 <= r.hold_like_measured <= r.hold_like_samples <= r.samples
    assert counts[99].unusable == 45 and counts[99].gated_out == 15 and counts[99].measured == 0
    rough = counts[3]
    assert rough.outliers + rough.filled > 60 and rough.gated_out >= 7 * len(clips.JOINTS) - 5
    assert counts[0].filled == counts[0].outliers == 0 and counts[0].hold_like_frames > 100
