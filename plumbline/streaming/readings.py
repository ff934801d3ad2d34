"""What one live frame shows, as Column expressions: up, in line, angles and framing.

A joint is a struct of x, y (0..1, y downwards) and visibility.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo

# Visibility, the line's limits, and the frame's.
SEEN = 0.5
LINE_LEAN, LINE_HIP = 15.0, 160.0
CONFIDENT, EDGE, LEAST_HEIGHT, SIGNIFICANT = 0.3, 0.04, 0.35, 6
REQUIRED = tuple(f"{side}_{part}" for part in ("wrist", "ankle", "shoulder", "hip") for side in ("left", "right"))


def seen(joint: Column, least: float = SEEN) -> Column:
    """The joint's point, null unless it is seen well."""
    return F.when(joint["visibility"] >= least, geo.point(joint["x"], joint["y"]))


def pair(joints: dict[str, Column], part: str, least: float = SEEN) -> Column:
    """Midpoint of a pair, null unless both are seen well."""
    return geo.midpoint(seen(joints[f"left_{part}"], least), seen(joints[f"right_{part}"], least))


def is_inverted(joints: dict[str, Column], least: float = SEEN) -> Column:
    """LIV5: ankles above wrists; by the hips where the ankles are not seen."""
    wrists, ankles, hips = (pair(joints, p, least) for p in ("wrist", "ankle", "hip"))
    return F.coalesce(ankles["y"] < wrists["y"], hips["y"] < wrists["y"], F.lit(False))


def is_up(joints: dict[str, Column], least: float = SEEN) -> Column:
    """LIV6: hips above wrists and ankles above hips."""
    wrists, ankles, hips = (pair(joints, p, least) for p in ("wrist", "ankle", "hip"))
    return F.coalesce((hips["y"] < wrists["y"]) & (ankles["y"] < hips["y"]), F.lit(False))


def hip_angle(joints: dict[str, Column], least: float = SEEN) -> Column:
    """LIV8: shoulder-hip-ankle angle of the side that is seen better; the left on a tie."""
    sides = []
    for i, side in enumerate(("left", "right")):
        parts = [joints[f"{side}_{p}"] for p in ("shoulder", "hip", "ankle")]
        angle = geo.angle_at(*(seen(p, least) for p in parts))
        score = sum((p["visibility"] for p in parts[1:]), parts[0]["visibility"]) / 3
        sides.append(F.when(angle.isNotNull(), F.struct(score.alias("score"), F.lit(-i).alias("order"), angle.alias("angle"))))
    return F.greatest(*sides)["angle"]


def body_lean(joints: dict[str, Column], least: float = SEEN) -> Column:
    """Degrees of the wrist-ankle vector from upright, null without length."""
    wrists, ankles = pair(joints, "wrist", least), pair(joints, "ankle", least)
    u, v = ankles["x"] - wrists["x"], wrists["y"] - ankles["y"]
    return F.when((u != 0) | (v != 0), F.degrees(F.atan2(u, v)))


def is_line(joints: dict[str, Column], red: Column, least: float = SEEN) -> Column:
    """LIV7: inverted, upright within the limit, hips open, and nothing red."""
    straight = (F.abs(body_lean(joints, least)) <= LINE_LEAN) & (hip_angle(joints, least) >= LINE_HIP) & pair(joints, "hip", least).isNotNull()
    return F.coalesce(is_inverted(joints, least) & straight & ~red, F.lit(False))


def chosen_fault(banana: Column, hip_angle: Column, banana_limit: float, hip_limit: float, hollow: Column, bent: Column) -> Column:
    """LIV11: arch, hips, hollow or bent, in this order."""
    return F.when(banana > banana_limit, "arch").when(hip_angle < hip_limit, "hips").when(hollow, "hollow").when(bent, "bent")


def framing(joints: DataFrame, frame: list[str], person: str) -> DataFrame:
    """LIV17: frame and status: noPerson, multiplePeople, partlyOutOfFrame, tooSmall or ok.

    ``joints`` has frame, person, joint, x, y and visibility. The verdict is about the person
    with most confident joints, the first on a tie.
    """
    sure = F.col("visibility") >= CONFIDENT
    needed = sure & F.col("joint").isin(*REQUIRED)
    edge = needed & ((F.col("x") < EDGE) | (F.col("x") > 1 - EDGE) | (F.col("y") < EDGE) | (F.col("y") > 1 - EDGE))
    people = joints.groupBy(*frame, person).agg(
        F.count(F.when(sure, 1)).alias("sure"), F.count(F.when(needed, 1)).alias("needed"), F.count(F.when(edge, 1)).alias("edges"), (F.max(F.when(sure, F.col("y"))) - F.min(F.when(sure, F.col("y")))).alias("height")
    )
    best = F.max(F.struct("sure", (-F.col(person)).alias("order"), "needed", "edges", "height"))
    frames = people.groupBy(*frame).agg(best.alias("b"), F.count(F.when(F.col("sure") >= SIGNIFICANT, 1)).alias("many"))
    b = F.col("b")
    status = (
        F.when(b["sure"] == 0, "noPerson")
        .when(F.col("many") > 1, "multiplePeople")
        .when((b["edges"] > 0) | (b["needed"] < len(REQUIRED)), "partlyOutOfFrame")
        .when(b["height"] < LEAST_HEIGHT, "tooSmall")
        .otherwise("ok")
    )
    return frames.select(*frame, status.alias("status"))
