"""Which body is which way up, which detections are one body, and which one a reference points at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import kernels, timeops

# The largest gap to a reference in body lengths, the least box overlap of the fallback, the opening in seconds.
MAX_GAP, MIN_FALLBACK_IOU, OPENING_S = 0.35, 0.1, 0.5
# The smoothing window in milliseconds, the margin that speaks against an orientation and for how long it must.
ORIENT_WINDOW_MS, ORIENT_MARGIN, ORIENT_SWITCH_MS = 500.0, 0.05, 300.0


def both_mean(left: Column, right: Column) -> Column:
    """ORI2: the mean of both, null if either is missing."""
    return (left + right) / 2


def mean_visibility(joints: DataFrame, keys: list[str], main: tuple[str, ...], joint: str = "joint", visibility: str = "visibility") -> DataFrame:
    """ORI4: keys and the mean visibility of a person's main joints."""
    return joints.where(F.col(joint).isin(*main)).groupBy(*keys).agg(F.avg(visibility).alias("visibility"))


def frame_margin(upright: Column, rotated: Column) -> Column:
    """ORI5: by how much the rotated reading scores higher; null if either is missing."""
    return rotated - upright


def opening_orientation(frames: DataFrame, keys: list[str], time: str, margin: str, span: float = OPENING_S) -> DataFrame:
    """ORI7: keys and opens_rotated: the sign of the mean margin of a clip's first half second (``span`` in the unit of time); upright if there is none."""
    first = F.min(time).over(Window.partitionBy(*keys))
    opening = frames.withColumn("_m", F.when(F.col(time) <= first + span, F.col(margin)))
    return opening.groupBy(*keys).agg(F.coalesce(F.avg("_m") > 0, F.lit(False)).alias("opens_rotated"))


def choose_orientations(frames: DataFrame, keys: list[str], t_ms: str, tie: str, upright: str, rotated: str) -> DataFrame:
    """ORI5-8 in a chain: ``frames`` with margin, smoothed and rotated: one orientation a frame, decided over the whole clip.

    A score that is null or NaN is no evidence. One shuffle by ``keys`` serves the windows and the fold.
    """
    margin = F.nanvl(frame_margin(F.col(upright).cast("double"), F.col(rotated).cast("double")), F.lit(None).cast("double"))
    rows = frames.withColumns({"margin": margin, "_t": F.col(t_ms).cast("double")})
    smooth = timeops.centred_mean(rows, keys, "_t", "margin", ORIENT_WINDOW_MS)
    w = Window.partitionBy(*keys)
    opening = F.when(F.col("_t") <= F.min("_t").over(w) + 1000 * OPENING_S, F.col("smoothed"))
    smooth = smooth.withColumn("_m", opening).withColumn("_opens", F.coalesce(F.avg("_m").over(w) > 0, F.lit(False)))
    out = kernels.switch_with_hysteresis(smooth, keys, "_t", tie, "smoothed", "_opens", ORIENT_MARGIN, ORIENT_SWITCH_MS)
    return out.drop("_t", "_m", "_opens")


def rotate_next(frames: DataFrame, keys: list[str], order: list[str], inverted: str, detected: str) -> DataFrame:
    """ORI9: ``frames`` with rotate: whether the last detected frame before this one was inverted."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(detected), F.col(inverted)), ignorenulls=True).over(before)
    return frames.withColumn("rotate", F.coalesce(last, F.lit(False)))


def tri_state_inverted(left_wrist: Column, right_wrist: Column, left_ankle: Column, right_ankle: Column) -> Column:
    """BAK25: whether the mean of the measured wrists is below that of the ankles (y grows downwards); null if neither can be told."""
    mean = lambda a, b: F.coalesce((a + b) / 2, a, b)
    return mean(left_wrist, right_wrist) > mean(left_ankle, right_ankle)


def hold_like(left_wrist: Column, right_wrist: Column, left_ankle: Column, right_ankle: Column) -> Column:
    """PP11, SMP10: BAK25, where what cannot be told is not."""
    return F.coalesce(tri_state_inverted(left_wrist, right_wrist, left_ankle, right_ankle), F.lit(False))


def without_twins(persons: DataFrame, pairs: DataFrame, frame: list[str], person: str, visibility: str = "visibility") -> DataFrame:
    """ATH10: ``persons`` without detections that are one body with another of the frame (``pairs``: frame, a, b with a < b).

    In the order of ``person``: one that is no twin of any kept so far is kept; else the more visible takes
    the place of the first twin. A frame's people (a handful) are folded in one array.
    """
    same = pairs.groupBy(*frame).agg(F.collect_set(F.struct("a", "b")).alias("_pairs"))
    each = F.struct(F.col(person).alias("p"), F.coalesce(F.col(visibility).cast("double"), F.lit(float("-inf"))).alias("v"))
    crowd = persons.groupBy(*frame).agg(F.array_sort(F.collect_list(each)).alias("_all")).join(same, frame)
    none = F.filter("_all", lambda x: F.lit(False))

    def twins(kept: Column, x: Column) -> Column:
        return F.filter(kept, lambda k: F.array_contains("_pairs", F.struct(F.least(k["p"], x["p"]).alias("a"), F.greatest(k["p"], x["p"]).alias("b"))))

    def step(kept: Column, x: Column) -> Column:
        first = F.get(twins(kept, x), F.lit(0))
        swapped = F.transform(kept, lambda k: F.when(k["p"] == first["p"], x).otherwise(k))
        return F.when(first.isNull(), F.concat(kept, F.array(x))).when(x["v"] > first["v"], swapped).otherwise(kept)

    kept = crowd.select(*frame, F.transform(F.aggregate("_all", none, step), lambda k: k["p"]).alias("_kept"))
    joined = persons.join(kept, frame, "left")
    return joined.where(F.col("_kept").isNull() | F.array_contains("_kept", F.col(person))).drop("_kept")


def inverted_first(persons: DataFrame, frame: list[str], person: str, inverted: str, score: str) -> DataFrame:
    """BAK5: of each frame the inverted person of best score, else the person of best score; the first on a tie."""
    best = Window.partitionBy(*frame).orderBy(F.coalesce(inverted, F.lit(False)).desc(), F.col(score).desc_nulls_last(), person)
    return persons.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def model_person(poses: DataFrame, frames: DataFrame, keys: list[str], detected: str = "detected") -> DataFrame:
    """BAK3: of the wanted frames, the detected rows of a model's own choice."""
    return poses.where(F.col(detected)).join(frames.select(*keys).distinct(), keys, "left_semi")


def pool(poses: DataFrame, frames: DataFrame, keys: list[str], person: str = "person_idx") -> DataFrame:
    """BAK4: of the wanted frames, everybody whom a model saw."""
    return poses.where(F.col(person) >= 0).join(frames.select(*keys).distinct(), keys, "left_semi")


def match_reference(persons: DataFrame, references: DataFrame, frame: list[str], person: str) -> DataFrame:
    """BAK19, BAK23: frame, person (null for a refusal) and rule.

    ``persons`` has gap (to the reference, in its lengths), box, inverted (null: unknown) and score; ``references`` has
    r_box, r_inverted and r_length. The least gap wins (more overlap, then order, on a tie) if it is small enough; else,
    where the reference reads upright, the inverted body whose box overlaps its box most; else nobody. Without a
    measured reference the best score wins.
    """
    both = persons.join(references, frame, "left")
    overlap = F.coalesce(geo.box_iou(F.col("box"), F.col("r_box")), F.lit(0.0))
    measured = F.coalesce(F.col("r_length") > 1.0, F.lit(False))
    ranked = both.select(*frame, person, "score", measured.alias("_m"), overlap.alias("_o"), F.coalesce("gap", F.lit(float("inf"))).alias("_g"), (F.coalesce(~F.col("r_inverted"), F.lit(False)) & F.coalesce("inverted", F.lit(False)) & (overlap > MIN_FALLBACK_IOU)).alias("_f"))
    agg = ranked.groupBy(*frame).agg(
        F.first("_m").alias("_m"),
        F.min(F.struct("_g", (-F.col("_o")).alias("o"), F.col(person).alias("p"))).alias("near"),
        F.min(F.when(F.col("_f"), F.struct((-F.col("_o")).alias("o"), F.col(person).alias("p")))).alias("fallback"),
        F.min(F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.col(person).alias("p"))).alias("sure"),
    )
    near = F.col("near._g") <= MAX_GAP
    chosen = F.when(~F.col("_m"), F.col("sure.p")).when(near, F.col("near.p")).otherwise(F.col("fallback.p"))
    rule = F.when(~F.col("_m"), "confidence").when(near, "keypoint_gap").when(F.col("fallback").isNotNull(), "orientation_fallback").otherwise("none")
    return agg.select(*frame, chosen.alias(person), rule.alias("rule"))


def disagreement_unit(reference: Column, candidate: Column, unmeasured: float = 1.0) -> Column:
    """BAK26: the reference's body length, else the candidate's, else null; what is not above ``unmeasured`` is no length."""
    return F.coalesce(F.when(reference > unmeasured, reference), F.when(candidate > unmeasured, candidate))


def _span(a: Column, b: Column) -> Column:
    """The root of the sum of squares, to the last digit as SQL has it; ``hypot`` may differ there."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def torso_length(left_shoulder: Column, right_shoulder: Column, left_hip: Column, right_hip: Column) -> Column:
    """GEO23: from the middle of the labelled shoulders to that of the labelled hips; null if either is missing or they coincide."""
    length = _span(geo.visible_midpoint(left_shoulder, right_shoulder), geo.visible_midpoint(left_hip, right_hip))
    return F.when(length > 0, length)


def normalised_error(label: Column, found: Column, length: Column) -> Column:
    """GEO24: the distance of two points in lengths, however short these are; null for a length of 0."""
    return F.when(length != 0, _span(label, found) / length)


def first_mismatch(own: Column, counterpart: Column, several_people: Column) -> Column:
    """ATH23: the bone that is too long for its clip, else, in clips of two people or more, that differs from its counterpart."""
    return F.coalesce(own, F.when(several_people, counterpart))


def frame_reads(persons: DataFrame, frame: list[str], time: str, person: str, detected: str, rotated: str) -> DataFrame:
    """ATH29: frame, time, detected and rotated (anyone), and wrist_y, ankle_y and inverted of the person with the lowest wrists."""
    lowest = F.min_by(F.struct("wrist_y", "ankle_y"), F.struct(F.coalesce(-F.col("wrist_y"), F.lit(float("inf"))), F.col(person)))
    read = persons.groupBy(*frame).agg(F.min(time).alias(time), F.bool_or(detected).alias("detected"), F.bool_or(rotated).alias("rotated"), lowest.alias("_p"))
    return read.select(*frame, time, "detected", "rotated", "_p.wrist_y", "_p.ankle_y", F.coalesce(F.col("_p.wrist_y") > F.col("_p.ankle_y"), F.lit(False)).alias("inverted"))
