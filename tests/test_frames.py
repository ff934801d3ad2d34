"""The pose chain over whole frames: it gives what the steps over samples, windows and columns give, draws no sample twice and has no method too long to compile."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import diagram, kernels, runs, scoring, stats
from plumbline.plans import pose, pose_queries
from plumbline.sources import clips

SF = "/root/testdata/sf0.001"
#: HotSpot compiles no method of more bytes.
HUGE_METHOD = 8000


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9, abs=1e-9))


def same(one, two, keys):
    sides = [{tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (one, two.select(*one.columns))]
    assert sides[0].keys() == sides[1].keys() and sides[0]
    for key, row in sides[0].items():
        assert [c for c, v in row.items() if not near(v, sides[1][key][c])] == [], key


@pytest.fixture(scope="module")
def samples(spark):
    """Clips of all stories, of which some samples are missing and some frames are told twice."""
    key = F.col("id")
    case = F.element_at(F.array(*map(F.lit, clips.NAMES)), (key % len(clips.NAMES) + 1).cast("int"))
    drawn = clips.clips(spark.range(6).select(key.alias("clip_id"), case.alias("case"), F.lit(5).alias("seed"), F.lit(1.1).alias("size"), F.lit(1).alias("copy")), ("copy",))
    place = F.abs(F.hash("clip_id", "frame_idx", "joint"))
    whole = drawn.where((place % 23 > 0) | (F.col("clip_id") == 0))
    twice = drawn.where("clip_id = 1").withColumns({"copy": F.lit(2), "x": F.col("x") + 0.5 * F.sin("frame_idx")})
    few = drawn.where("clip_id = 2 and frame_idx < 6").withColumn("clip_id", F.lit(77).cast("long"))
    return whole.unionByName(twice).unionByName(few).cache()


@pytest.fixture(scope="module")
def frames(samples):
    return pose.clean_frames(samples, ("copy",)).cache()


def test_frames_are_what_clean_makes_of_samples(samples, frames):
    once = samples.where("clip_id <> 1")
    same(frames.where("clip_id <> 1"), pose.wide(pose.clean(once.drop("copy")), ["trainer_contact", "body_length"]), ["clip_id", "frame_idx", "t_ms"])
    assert frames.where("clip_id = 77 and body_length is null and nose_x is null").count() == 6


def test_frames_told_twice_are_one(samples, frames):
    assert frames.where("clip_id = 1").groupBy("frame_idx").count().where("count > 1").count() == 0
    # of equal times the samples' order is open: only where they are alike it makes no difference
    alike = samples.where("clip_id = 3")
    alike = alike.unionByName(alike.withColumn("copy", F.lit(2)))
    same(pose.clean_frames(alike, ("copy",)), pose.wide(pose.clean(alike.drop("copy")), ["trainer_contact", "body_length"]), ["clip_id", "frame_idx", "t_ms"])


def test_no_sample_is_drawn_twice_and_all_methods_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        features = pose.body_features(pose_queries.classified(spark, SF), keep=("body", "body_length"))
        sizes = scoring.severities({f: (0.0, 1.0) for f in pose_queries.RULES.features}, pose_queries.RULES)
        execution = diagram.diagram_words(features, sizes)._jdf.queryExecution()
        assert execution.executedPlan().toString().count("md5(") == 1
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(execution.executedPlan())
        assert stages.size() > 5 and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < HUGE_METHOD
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_clips_are_dealt_however_many_partitions_a_shuffle_has(spark):
    drawn = pose_queries.classified(spark, SF)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        # as many as the clips are dealt to, here one
        assert pose_queries.classified(spark, SF)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_pose_diagram_stores_no_frames(spark, monkeypatch):
    monkeypatch.setattr(pose_queries, "settled", None)
    assert pose_queries.pose_diagram(spark, SF).where("bones like '%:bad%'").count() > 0


def test_holds_and_phases_equal_the_windows(spark):
    draw = random.Random(9)
    rows = []
    for k in range(60):
        t, p = 0.0, draw.choice((0.3, 0.8, 0.95))
        for i in range(draw.choice((1, 3, 40, 90))):
            t += draw.choice((0.0, 0.03, 0.1, 0.25))
            known = draw.random() < 0.9
            rows.append((k, t, i, known and draw.random() < p, known and draw.random() < 0.1, known, known and draw.random() < 0.3, draw.random() < 0.3, known and draw.random() < 0.6, draw.choice((1, 1, -1, None))))
    df = spark.createDataFrame(rows, "clip_id int, t double, frame_idx int, holding boolean, hand_step boolean, known boolean, hands_down boolean, rising boolean, hands_low boolean, own_facing int").cache()
    held = runs.hold_runs(df, pose.CLIP, "t", "frame_idx", "holding", "hand_step", pose.MIN_HOLD_S, pose.MAX_BREAK_S)
    want = runs.phases(held, pose.CLIP, "t", "frame_idx", "known", "hands_down", "rising", "hands_low")
    want = want.withColumn("facing_sign", F.when(F.col("hold_id") >= 0, stats.majority_sign("own_facing", ["clip_id", "hold_id"])).otherwise(F.col("own_facing")))
    same(pose.classify(df), want, ["clip_id", "frame_idx"])
    assert {r.phase for r in want.select("phase").distinct().collect()} == set(kernels.PHASES) and want.where("hold_id > 1").count()


def test_features_equal_the_columns(spark, frames):
    classified = pose.classify(pose.motion(frames.withColumns({f"{j}_{c}": F.when(F.abs(F.hash("clip_id", "frame_idx", F.lit(j))) % 9 > 0, F.col(f"{j}_{c}")) for j in pose.BODY for c in "xy"}))).cache()
    found = pose.body_features(classified, keep=("body", "body_length"))
    size = F.when(F.col("body_length") > 0, F.col("body_length"))
    raw = {j: geo.point(F.col(f"body.{j}_x"), F.col(f"body.{j}_y")) for j in pose.BODY}
    mids = {q: geo.visible_midpoint(raw[f"left_{q}"], raw[f"right_{q}"]) for q in pose.PARTS}
    placed = classified.select("*", *(geo.to_body_frame(c, mids["wrist"], size).alias(n) for n, c in (raw | mids).items()))
    p = {n: F.col(n) for n in (*raw, *mids)}
    both = lambda *joints: geo.side_mean(*(geo.angle_at(*(p[f"{s}_{j}"] for j in joints)) for s in ("left", "right")))
    mass = geo.centre_of_mass({j: p[j] for j in pose.BODY})
    want = placed.select(
        "clip_id", "frame_idx", *(p[q]["x"].alias(f"off_{q}") for q in ("shoulder", "hip", "knee", "ankle")), both("hip", "shoulder", "wrist").alias("shoulder_angle"), both("shoulder", "hip", "knee").alias("hip_angle"),
        both("hip", "knee", "ankle").alias("knee_angle"), both("shoulder", "elbow", "wrist").alias("elbow_angle"), geo.banana(p["shoulder"], p["hip"], p["ankle"], p["nose"]).alias("banana"),
        geo.head_angle(p["hip"], p["shoulder"], p["nose"]).alias("head"), geo.angle_between(*(geo.minus(p[f"{s}_ankle"], p[f"{s}_hip"]) for s in ("left", "right"))).alias("leg_separation"),
        geo.ratio(geo.distance(p["left_wrist"], p["right_wrist"]), geo.distance(p["left_shoulder"], p["right_shoulder"])).alias("hand_width"), mass["x"].alias("com_u"), mass["y"].alias("com_v"), mass["complete"].alias("com_complete"),
        F.degrees(F.atan2(p["ankle"]["x"], p["ankle"]["y"])).alias("body_angle"), geo.row_max(*(F.abs(p[q]["x"]) for q in ("shoulder", "hip", "knee", "ankle"))).alias("line_deviation"),
        (p["wrist"].isNotNull() & p["elbow"].isNotNull() & p["shoulder"].isNotNull() & p["hip"].isNotNull() & p["knee"].isNotNull() & p["ankle"].isNotNull()).alias("valid"),
    )
    same(want, found, ["clip_id", "frame_idx"])
    own = placed.select("clip_id", "frame_idx", geo.torso_facing_sign(p["shoulder"], p["hip"], p["nose"]).alias("facing_sign"))
    same(own.join(classified.where("hold_id < 0").select("clip_id", "frame_idx"), ["clip_id", "frame_idx"]), classified.where("hold_id < 0"), ["clip_id", "frame_idx"])
    # what is drawn, as arrays and as words
    words = diagram.diagram_words(found, scoring.severities(None, pose_queries.RULES))
    arrays = diagram.diagram_frames(scoring.frame_severities(pose.pictured(found), None, pose_queries.RULES), F.lit(1080))
    text = F.array_join(F.transform("bones", lambda b: F.concat(b["start"], F.lit("-"), b["end"], F.lit(":"), b["band"])), " ")
    want = arrays.select("clip_id", "frame_idx", "in_hold", F.size("joints").alias("n_joints"), text.alias("bones"), F.col("stack.x").alias("stack_x"), "stack_band", F.col("com.x").alias("com_x"), F.col("com.y").alias("com_y"), "balance_zone")
    same(want, words, ["clip_id", "frame_idx"])
