"""Geometry of poses as Column expressions: body frame, angles, boxes and centre of mass.

A point is a struct of ``x`` and ``y`` (``u`` and ``v`` in the body frame: wrists' midpoint at 0,
one body length per unit, v up). Null means not measured, and spreads through arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances and the body model (mass share, place along the segment).
MIN_SEGMENT_L = 1e-9
BASE_BACK, BASE_FRONT = 0.03, 0.06
HEAD_FALLBACK = 0.5
HEAD = ("head", 0.081)
TRUNK = ("trunk", 0.497, 0.5)
LIMBS = (
    ("upper_arm", "shoulder", "elbow", 0.028, 0.436),
    ("forearm_hand", "elbow", "wrist", 0.022, 0.682),
    ("thigh", "hip", "knee", 0.100, 0.433),
    ("shank", "knee", "ankle", 0.0465, 0.433),
    ("foot", "ankle", "foot_index", 0.0145, 0.5),
)
MIN_VISIBILITY = 0.5
VISIBILITY_MARGIN = 0.1


def point(x: Column, y: Column) -> Column:
    """A point, null unless both coordinates are known."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def finite(x: Column) -> Column:
    """NaN and infinities as null: the boundary at which files enter the engine."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def to_body_frame(p: Column, wrists: Column, body_length: Column) -> Column:
    """GEO1: offsets from the wrists' midpoint in body lengths, upwards positive."""
    size = F.when(body_length > 0, body_length)
    return point((p["x"] - wrists["x"]) / size, (wrists["y"] - p["y"]) / size)


def midpoint(a: Column, b: Column) -> Column:
    """GEO2: null unless both ends are known."""
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def visible_midpoint(*points: Column) -> Column:
    """GEO3, SIG1: mean of the known points."""
    if len(points) == 2:
        return F.coalesce(midpoint(*points), *points)
    known = F.filter(F.array(*points), lambda p: p.isNotNull())
    n = F.size(known)
    total = F.aggregate(known, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y")))
    return F.when(n > 0, F.struct((total["x"] / n).alias("x"), (total["y"] / n).alias("y")))


def side_mean(left: Column, right: Column) -> Column:
    """GEO4: mean of both sides, else the one that is known."""
    return F.coalesce((left + right) / 2, left, right)


def angle_between(a: Column, b: Column) -> Column:
    """GEO5: unsigned degrees between two vectors; null for a vector of no length."""
    cross = a["x"] * b["y"] - a["y"] * b["x"]
    dot = a["x"] * b["x"] + a["y"] * b["y"]
    long = (F.hypot(a["x"], a["y"]) > MIN_SEGMENT_L) & (F.hypot(b["x"], b["y"]) > MIN_SEGMENT_L)
    return F.when(long, F.degrees(F.atan2(F.abs(cross), dot)))


def angle_at(first: Column, middle: Column, last: Column) -> Column:
    """GEO6: interior angle at the middle joint."""
    return angle_between(minus(first, middle), minus(last, middle))


def row_max(*values: Column) -> Column:
    """GEO7, SIG4: greatest of the known values."""
    return F.greatest(*values) if len(values) > 1 else values[0]


def distance(a: Column, b: Column) -> Column:
    """GEO8."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def ratio(numerator: Column, denominator: Column) -> Column:
    """GEO9: null for a denominator of about 0."""
    return F.when(F.abs(denominator) > MIN_SEGMENT_L, numerator / denominator)


def line_side(origin: Column, end: Column, p: Column) -> Column:
    """Signed distance of p from the line, positive to its left when y points up; null for a line of no length."""
    dx, dy = end["x"] - origin["x"], end["y"] - origin["y"]
    size = F.hypot(dx, dy)
    return F.when(size > MIN_SEGMENT_L, (dx * (p["y"] - origin["y"]) - dy * (p["x"] - origin["x"])) / size)


def sign(x: Column) -> Column:
    """1 or -1, null for 0."""
    return F.when(x > 0, F.lit(1)).when(x < 0, F.lit(-1))


def facing_sign(shoulders: Column, ankles: Column, nose: Column) -> Column:
    """GEO10: on which side of the shoulder-ankle line the nose lies; null on the line."""
    return sign(line_side(shoulders, ankles, nose))


def torso_facing_sign(shoulders: Column, hips: Column, nose: Column) -> Column:
    """GEO13: on which side of the torso the nose lies, +1 towards +u whichever way the torso leans."""
    ax, ay = hips["x"] - shoulders["x"], hips["y"] - shoulders["y"]
    across = (nose["x"] - shoulders["x"]) * ay - (nose["y"] - shoulders["y"]) * ax
    return sign(F.when(ay < 0, -across).otherwise(across))


def banana(shoulders: Column, hips: Column, ankles: Column, nose: Column) -> Column:
    """GEO11: hip distance from the shoulder-ankle line, positive towards the nose's side."""
    return line_side(shoulders, ankles, hips) * facing_sign(shoulders, ankles, nose)


def head_angle(hips: Column, shoulders: Column, nose: Column) -> Column:
    """GEO12: angle of the head against the torso's direction."""
    return angle_between(minus(shoulders, hips), minus(nose, shoulders))


def along(a: Column, b: Column, part: float) -> Column:
    """GEO15: the point a share of the way from a to b."""
    return point(a["x"] + (b["x"] - a["x"]) * part, a["y"] + (b["y"] - a["y"]) * part)


def head_point(nose: Column, shoulders: Column, hips: Column) -> Column:
    """GEO14: the nose, else half a torso beyond the shoulders."""
    return F.coalesce(nose, along(hips, shoulders, 1 + HEAD_FALLBACK))


def mass_parts(joints: dict[str, Column], shoulders: Column, hips: Column) -> list[tuple[Column, float]]:
    """Centre and mass of head, trunk and both sides' limbs; a limb that is not known copies its counterpart. Without any toe joint a foot ends at the ankle."""
    parts = [(head_point(joints["nose"], shoulders, hips), HEAD[1]), (along(shoulders, hips, TRUNK[2]), TRUNK[1])]
    for _, near, far, mass, part in LIMBS:
        ends = {}
        for side in ("left", "right"):
            end = joints.get(f"{side}_{far}", joints[f"{side}_ankle"] if far == "foot_index" else None)
            ends[side] = along(joints[f"{side}_{near}"], end, part)
        parts += [(F.coalesce(ends["left"], ends["right"]), mass), (F.coalesce(ends["right"], ends["left"]), mass)]
    return parts


def mass_centre(parts: list[tuple[Column, float]]) -> Column:
    """Struct of x, y, mass and complete: the sum of the known parts over their mass. Parts that are columns keep the expression short: each is read eight times."""
    weights = [F.when(p.isNotNull(), F.lit(m)).otherwise(0.0) for p, m in parts]
    mass = reduce(lambda a, b: a + b, weights)
    total = {c: reduce(lambda a, b: a + b, [F.coalesce(p[c] * m, F.lit(0.0)) for p, m in parts]) for c in ("x", "y")}
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p, _ in parts])
    known = F.when(mass > 0, mass)
    return F.struct((total["x"] / known).alias("x"), (total["y"] / known).alias("y"), mass.alias("mass"), complete.alias("complete"))


def centre_of_mass(joints: dict[str, Column]) -> Column:
    """GEO16: ``mass_centre`` of the ``mass_parts`` of a body."""
    return mass_centre(mass_parts(joints, side_point(joints, "shoulder"), side_point(joints, "hip")))


def side_point(joints: dict[str, Column], name: str) -> Column:
    """Mean point of a pair of joints, or the one that is known."""
    return visible_midpoint(joints[f"left_{name}"], joints[f"right_{name}"])


def balance_zone(forward: Column) -> Column:
    """GEO18: under, ok or over the base of support; null when not measured."""
    return F.when(forward < -BASE_BACK, "under").when(forward > BASE_FRONT, "over").when(forward.isNotNull(), "ok")


def box_iou(a: Column, b: Column) -> Column:
    """ATH6: intersection over union of boxes (x0, y0, x1, y1); 0 when apart or empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def segment_distance(p: Column, start: Column, end: Column) -> Column:
    """ATH7: distance to the nearest point of a segment."""
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - start["x"]) * dx + (p["y"] - start["y"]) * dy) / square))).otherwise(0.0)
    return F.hypot(p["x"] - (start["x"] + t * dx), p["y"] - (start["y"] + t * dy))


def rotate_point(p: Column, angle: float, width: Column, height: Column) -> Column:
    """ORI10: quarter turns are exact pixel maps (clockwise); other angles turn about the centre."""
    x, y, turn = p["x"], p["y"], angle % 360
    if turn == 0:
        return p
    if turn == 90:
        return point(height - 1 - y, x)
    if turn == 180:
        return point(width - 1 - x, height - 1 - y)
    if turn == 270:
        return point(y, width - 1 - x)
    cx, cy, a = (width - 1) / 2, (height - 1) / 2, F.radians(F.lit(float(turn)))
    return point(cx + (x - cx) * F.cos(a) - (y - cy) * F.sin(a), cy + (x - cx) * F.sin(a) + (y - cy) * F.cos(a))


def inverse_rotate_point(p: Column, angle: float, width: Column, height: Column) -> Column:
    """ORI11: undoes ``rotate_point`` of a picture that was width x height before the turn."""
    turned = angle % 360 in (90, 270)
    return rotate_point(p, -angle, height if turned else width, width if turned else height)


def to_pixels(p: Column, width: Column, height: Column) -> Column:
    """ORI12: from 0..1 to pixel indices."""
    return point(p["x"] * (width - 1), p["y"] * (height - 1))


def percent_to_pixels(p: Column, width: Column, height: Column) -> Column:
    """LAB4: from label percentages to pixel indices."""
    return to_pixels(point(p["x"] / 100, p["y"] / 100), width, height)


def is_inverted(wrist_y: Column, ankle_y: Column) -> Column:
    """ORI1, ATH30, LIV5: wrists below ankles in the picture; not inverted when unknown."""
    return F.coalesce(wrist_y > ankle_y, F.lit(False))


def view_width(left_shoulder: Column, right_shoulder: Column, left_hip: Column, right_hip: Column, body_length: Column) -> Column:
    """GEO22: how far shoulders and hips spread across the torso, in body lengths."""
    torso_a, torso_b = midpoint(left_hip, right_hip), midpoint(left_shoulder, right_shoulder)
    dx, dy = torso_b["x"] - torso_a["x"], torso_b["y"] - torso_a["y"]
    size = F.hypot(dx, dy)
    across = lambda a, b: F.abs((b["x"] - a["x"]) * dy - (b["y"] - a["y"]) * dx) / size
    return F.when((size > MIN_SEGMENT_L) & (body_length > 0), (across(left_shoulder, right_shoulder) + across(left_hip, right_hip)) / 2 / body_length)


def predicted_shape(leg: Column, knee: Column, hip: Column) -> Column:
    """SHP1, SEG10: tuck, straddle, pike or line, in this order; unmeasured without angles that decide."""
    unknown = knee.isNull() | hip.isNull() | leg.isNull()
    return F.when(unknown, "unmeasured").when(knee < 120.0, "tuck").when(leg > 45.0, "straddle").when(hip < 140.0, "pike").otherwise("line")


def near_side_from_nose(nose_x: Column, shoulders_x: Column, inverted: Column, min_offset: float = 2.0) -> Column:
    """AGG31: the side towards the camera from where the nose points; null within the offset."""
    right = (nose_x - shoulders_x) > 0
    return F.when(F.abs(nose_x - shoulders_x) < min_offset, F.lit(None)).when(right != inverted, "right").when(right == inverted, "left")


def claimed_near_side(left: Column, right: Column, margin: float = VISIBILITY_MARGIN) -> Column:
    """AGG32: the side that is more visible by the margin."""
    return F.when(left - right >= margin, "left").when(right - left >= margin, "right")


def near_side_from_depth(left_z: Column, right_z: Column, margin: float = 0.05) -> Column:
    """AGG33: the side with the smaller depth by the margin."""
    return F.when(right_z - left_z >= margin, "left").when(left_z - right_z >= margin, "right")


def live_banana(shoulder: Column, hip: Column, ankle: Column, nose: Column) -> Column:
    """LIV12: struct of magnitude and signed bend of one frame, scaled by its own trunk and legs; null where a midpoint is missing, signed null without a nose."""
    flip = lambda p: point(p["x"], -p["y"])
    size = distance(shoulder, hip) + distance(hip, ankle)
    a, b, c = flip(shoulder), flip(hip), flip(ankle)
    bend = line_side(a, c, b) / F.when(size > MIN_SEGMENT_L, size)
    return F.when(bend.isNotNull(), F.struct(F.abs(bend).alias("magnitude"), (bend * facing_sign(a, c, flip(nose))).alias("signed")))
