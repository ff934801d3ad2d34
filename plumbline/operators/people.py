"""Choosing the athlete among the people of a frame: duplicates, scores, sweeps and contact."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import kernels
from plumbline.operators.matching import without_twins

# Weights of a person's score, and the limits of the choice.
INVERSION, SUPPORT, CONTINUITY, VISIBILITY = 0.4, 0.2, 0.3, 0.1
LEAST_SCORE = 0.35
MARGIN = 0.05
HIP_TOLERANCE, JOINT_TOLERANCE, SHARED_JOINTS = 0.15, 0.10, 4
CONTACT_IOU = 0.3


def people(joints: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """ATH1-5, ATH8: a row a person: wrist, hip and ankle means, box, length, visibility, inverted.

    ``joints`` has keys (clip, frame, person), joint, x, y and visibility.
    """
    seen = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("visibility") >= least)
    mean = lambda axis, part: F.avg(F.when(seen & F.col("joint").isin(f"left_{part}", f"right_{part}"), F.col(axis)))
    edge = lambda f, axis: f(F.when(seen, F.col(axis)))
    agg = joints.groupBy(*keys).agg(
        *(mean(axis, part).alias(f"{part}_{axis}") for part in ("wrist", "hip", "ankle", "shoulder") for axis in ("x", "y")),
        edge(F.min, "x").alias("x0"), edge(F.min, "y").alias("y0"), edge(F.max, "x").alias("x1"), edge(F.max, "y").alias("y1"),
        F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_diagonal"),
        F.avg("visibility").alias("visibility"),
    )
    body = F.hypot(F.col("shoulder_x") - F.col("ankle_x"), F.col("shoulder_y") - F.col("ankle_y"))
    inverted = F.coalesce(F.col("wrist_y") > F.col("ankle_y"), F.lit(False))
    return agg.withColumns({"length": F.greatest(F.coalesce(body, "_diagonal"), F.lit(1.0)), "inverted": inverted}).drop("_diagonal")


def support_score(wrist_y: Column, line: Column, length: Column) -> Column:
    """ATH12: how near the wrists are to the frame's lowest ones."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (line - wrist_y) / length)), F.lit(0.0))


def same_body_pairs(joints: DataFrame, persons: DataFrame, frame: list[str], person: str) -> DataFrame:
    """ATH9: frame, a and b: pairs of a frame that are one body seen twice. Frames hold a few people."""
    a, b = joints.alias("a"), joints.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in frame] + [F.col("a.joint") == F.col("b.joint"), F.col(f"a.{person}") < F.col(f"b.{person}")]
    shared = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in frame), F.col(f"a.{person}").alias("a"), F.col(f"b.{person}").alias("b"), F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("d"))
    near = shared.where("d is not null").groupBy(*frame, "a", "b").agg(F.median("d").alias("d"), F.count(F.lit(1)).alias("n"))
    size = persons.select(*frame, F.col(person).alias("p"), "length", "hip_x", "hip_y")
    pa = size.select(*frame, F.col("p").alias("a"), F.col("length").alias("la"), F.col("hip_x").alias("ax"), F.col("hip_y").alias("ay"))
    pb = size.select(*frame, F.col("p").alias("b"), F.col("length").alias("lb"), F.col("hip_x").alias("bx"), F.col("hip_y").alias("by"))
    both = near.join(pa, [*frame, "a"]).join(pb, [*frame, "b"]).withColumn("l", F.greatest("la", "lb"))
    close = (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= HIP_TOLERANCE * F.col("l")) & (F.col("d") < JOINT_TOLERANCE * F.col("l"))
    return both.where(close & (F.col("n") >= SHARED_JOINTS)).select(*frame, "a", "b")


def _swept(batches: Iterator[pa.RecordBatch], clip: list[str], frame: str, person: str) -> Iterator[pa.RecordBatch]:
    """ATH14-18: a row a frame with the person chosen; the rows of a frame lie behind one another in order of person, and so do a clip's frames."""
    hip = last = None
    for rows in kernels._whole_series(batches):
        begins = np.flatnonzero(rows.column("_begins").to_numpy())
        x, y, length, still = (kernels._numbers(rows.column(c).chunk(0)) for c in ("hip_x", "hip_y", "length", "still"))
        known = np.isfinite(x) & np.isfinite(y)
        frames = rows.select([*clip, frame]).take(pa.array(begins))
        clips = list(zip(*(frames.column(k).to_pylist() for k in clip), strict=True))
        picked, best_scores = np.full(len(begins), -1), np.empty(len(begins))
        for i, (a, b) in enumerate(zip(begins, np.append(begins[1:], rows.num_rows), strict=True)):
            hip, last = hip if clips[i] == last else None, clips[i]
            near = np.ones(b - a)
            if hip is not None:
                with np.errstate(all="ignore"):
                    near = np.where(known[a:b], np.clip(1 - np.hypot(x[a:b] - hip[0], y[a:b] - hip[1]) / length[a:b], 0.0, 1.0), 1.0)
            scores = still[a:b] + CONTINUITY * near
            # a frame's rows are in order of person, who decides a tie
            order = np.argsort(-scores, kind="stable")
            best, second = order[0], scores[order[1]] if len(order) > 1 else -math.inf
            best_scores[i] = scores[best]
            if scores[best] < LEAST_SCORE or scores[best] - second <= MARGIN:
                continue
            picked[i] = a + best
            if known[a + best]:
                hip = (x[a + best], y[a + best])
        chosen = rows.column(person).take(pa.array(picked, mask=picked < 0))
        yield from frames.append_column(person, chosen).append_column("score", pa.array(best_scores, from_pandas=True)).to_batches()


def choose_athlete(persons: DataFrame, clip: list[str], frame: str, person: str, joints: DataFrame | None = None) -> DataFrame:
    """ATH14-18: clip, frame, the chosen person (null for nobody) and its score.

    With the persons' ``joints``, detections of one body are collapsed first (ATH9, ATH10). The choice depends on where the athlete was, so a clip is swept
    frame by frame, forwards in one task and backwards in another, which hold some frames at a time; per frame the better of the two counts.
    """
    if joints is not None:
        pairs = same_body_pairs(joints, persons, [*clip, frame], person)
        persons = without_twins(persons, pairs, [*clip, frame], person)
    who = F.col(person).asc_nulls_last()
    w = Window.partitionBy(*clip, frame).orderBy(who)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = persons.withColumns({"line": F.max("wrist_y").over(whole), "_begins": F.row_number().over(w) == 1})
    still = INVERSION * F.col("inverted").cast("double") + SUPPORT * support_score(F.col("wrist_y"), F.col("line"), F.col("length")) + VISIBILITY * F.coalesce("visibility", F.lit(0.0))
    # both sweeps read one exchange
    dealt = lines.select(*clip, frame, F.col(person).cast("long").alias(person), "hip_x", "hip_y", "length", still.alias("still"), "_begins").repartition(*clip)

    types = {f.name: f.dataType.simpleString() for f in persons.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*clip, frame]) + f", `{person}` bigint, score double"

    def sweep(at: Column, name: str) -> DataFrame:
        found = dealt.sortWithinPartitions(*clip, at, F.col("_begins").desc(), who).mapInArrow(lambda batches: _swept(batches, clip, frame, person), schema)
        return found.select(*clip, frame, F.struct(person, "score").alias("_pick"), F.lit(name).alias("_way"))

    ways = sweep(F.col(frame).asc_nulls_last(), "there").unionByName(sweep(F.col(frame).desc_nulls_first(), "back"))
    both = ways.groupBy(*clip, frame).agg(*(F.max(F.when(F.col("_way") == n, F.col("_pick"))).alias(n) for n in ("there", "back")))
    above = lambda a, b: F.coalesce(F.col(f"{a}.score") > F.col(f"{b}.score"), F.lit(False))
    back = ~above("there", "back") & (above("back", "there") | F.col(f"back.{person}").isNotNull())
    return both.select(*clip, frame, F.when(back, F.col("back")).otherwise(F.col("there")).alias("_pick")).select(*clip, frame, "_pick.*")


def lowest_wrists(persons: DataFrame, frame: list[str], person: str) -> DataFrame:
    """ORI3, SRC7: the person of each frame whose wrists are lowest; the first on a tie, unknown last."""
    w = Window.partitionBy(*frame).orderBy(F.col("wrist_y").desc_nulls_last(), person)
    return persons.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bone_limits(joints_wide: DataFrame, clip: list[str], bones: dict[str, tuple[str, str]]) -> DataFrame:
    """ATH19, ATH20: clip and the p90 of every bone, from wide rows with a point a joint."""
    lengths = {b: F.hypot(F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.y") - F.col(f"{q}.y")) for b, (p, q) in bones.items()}
    return joints_wide.groupBy(*clip).agg(*(F.percentile(c, F.lit(0.9)).alias(b) for b, c in lengths.items()))


def contact_reason(iou: Column, mixed: Column, bones: Column) -> Column:
    """ATH26: the first rule that fires."""
    return F.when(iou > CONTACT_IOU, "box_iou").when(mixed, "mixed_skeleton").when(bones, "bone_length").otherwise("")


def people_histogram(frames: DataFrame, clip: list[str], n_people: str) -> DataFrame:
    """ORI13: clip and frames by number of people."""
    counts = frames.groupBy(*clip, n_people).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*clip).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(n_people, "n")))).alias("frames_by_people"))

# Bones by their ends, and joints of the limbs.
BONES = {f"{side}_{name}": (f"{side}_{a}", f"{side}_{b}") for side in ("left", "right") for name, a, b in (("upper_arm", "shoulder", "elbow"), ("forearm", "elbow", "wrist"), ("thigh", "hip", "knee"), ("shin", "knee", "ankle"))}
TOLERANCE = 0.35


def bone_length(bone: str) -> Column:
    """ATH19: from a wide row with a point a joint."""
    a, b = BONES[bone]
    return F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))


def bone_outlier(limits: str) -> Column:
    """ATH21: the first bone that is longer than its clip's p90 (a struct column) allows; null for none."""
    found = F.lit(None).cast("string")
    for bone in reversed(BONES):
        full = F.col(f"{limits}.{bone}")
        found = F.when((full > 0) & (bone_length(bone) > full * (1 + TOLERANCE)), F.lit(bone)).otherwise(found)
    return found


def counterpart_outlier() -> Column:
    """ATH22: the first bone whose length differs from its counterpart's by more than the tolerance of the longer."""
    found = F.lit(None).cast("string")
    for bone in reversed([b for b in BONES if b.startswith("left_")]):
        a, b = bone_length(bone), bone_length(bone.replace("left_", "right_"))
        longer = F.greatest(a, b)
        found = F.when(a.isNotNull() & b.isNotNull() & (longer > 0) & (F.abs(a - b) / longer > TOLERANCE), F.lit(bone)).otherwise(found)
    return found


def mixed_skeleton(athlete: DataFrame, others: DataFrame, frame: list[str]) -> DataFrame:
    """ATH24, ATH25: frame and mixed: whether a limb joint of the athlete is nearer to another body than to its own line.

    ``athlete`` has frame, limb joints (x, y) and the line (feet, head); ``others`` the other people's joints of the frame.
    """
    points = athlete.select(*frame, "joint", geo.point(F.col("x"), F.col("y")).alias("_p"), "feet", "head")
    near = points.join(others.select(*frame, F.col("x").alias("o_x"), F.col("y").alias("o_y")), frame)
    gap = near.groupBy(*frame, "joint", "_p", "feet", "head").agg(F.min(F.hypot(F.col("_p.x") - F.col("o_x"), F.col("_p.y") - F.col("o_y"))).alias("gap"))
    closer = F.coalesce(F.col("gap") < geo.segment_distance(F.col("_p"), F.col("feet"), F.col("head")), F.lit(False))
    return gap.groupBy(*frame).agg(F.bool_or(closer).alias("mixed"))
