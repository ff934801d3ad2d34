"""Reviewed holds and labels: which are side views or lines, what they measure, and roll-ups of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.orders import exact_quantiles

# Words of labels.
SIDE, NOT_SIDE, LINE, EMPTY, MIXED = "side", "not_side", "line", "empty", "mixed"


def image_index(rows: DataFrame, image: str, order: list[str]) -> DataFrame:
    """LAB1: one row of a manifest for each image, the last one."""
    last = Window.partitionBy(image).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def reference_holds(reviews: DataFrame, accepted: str, wall: str) -> DataFrame:
    """LAB9: reviews that are accepted and not at a wall."""
    return reviews.where(F.coalesce(F.col(accepted), F.lit(False)) & ~F.coalesce(F.col(wall), F.lit(False)))


def line_flag(holds: DataFrame, shapes: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """LAB14: ``holds`` with is_line: reviewed as a line; what was not reviewed is none."""
    return holds.join(shapes.select(*keys, F.col(shape).alias("_s")), keys, "left").withColumn("is_line", F.coalesce(F.col("_s") == LINE, F.lit(False))).drop("_s")


def line_holds(holds: DataFrame, shapes: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """LAB15: the holds reviewed as a line."""
    return holds.join(shapes.where(F.col(shape) == LINE), keys, "left_semi")


def keyed_shapes(rows: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """LAB16, SRC23: rows of whole-number keys (the first as it is) with a value; others are left out."""
    typed = rows.select(keys[0], *(F.col(k).try_cast("bigint").alias(k) for k in keys[1:]), shape)
    known = F.coalesce(F.trim(shape), F.lit("")) != ""
    for k in keys[1:]:
        known = known & F.col(k).isNotNull()
    return typed.where(known)


def side_views(holds: DataFrame, angles: DataFrame, detected: DataFrame | None, clip: str, hold: str) -> DataFrame:
    """SCO9: ``holds`` with is_side and note. A hand label (angle) decides; where it is empty, a detected view, if there are any."""
    angle = F.lower(F.trim(F.coalesce("angle", F.lit(""))))
    both = holds.join(angles, clip, "left").withColumn("_a", angle)
    if detected is None:
        both = both.withColumn("_v", F.lit(None).cast("string"))
    else:
        both = both.join(detected.select(clip, hold, F.col("view").alias("_v")), [clip, hold], "left")
    by_view = (F.col("_a") == "") & F.lit(detected is not None)
    side = F.when(by_view, F.coalesce(F.col("_v") == SIDE, F.lit(False))).otherwise(F.col("_a") == SIDE)
    read = F.concat(F.lit("camera_angle="), F.when(F.col("_a") == "", F.lit(EMPTY)).otherwise(F.col("_a")))
    read = F.when(by_view, F.concat(read, F.lit(", detected="), F.coalesce("_v", F.lit("none")))).otherwise(read)
    note = F.when(~side, F.concat(F.col(clip).cast("string"), F.lit(" h"), F.col(hold).cast("string"), F.lit(": not side view ("), read, F.lit(")"))).otherwise(F.lit(""))
    return both.withColumn("is_side", side).withColumn("note", note).drop("_a", "_v", "angle")


def is_side_window(angle: Column, origin: Column, window_view: Column, hold_view: Column) -> Column:
    """SCO24: a hand label decides; where it is empty, the view of the window if it is a segment, else that of the hold."""
    seen = F.when(origin == "segment", window_view).otherwise(hold_view)
    return F.when(F.coalesce(angle, F.lit("")) != "", angle == SIDE).otherwise(F.coalesce(seen == SIDE, F.lit(False)))


def side_scores(scores: DataFrame, views: DataFrame, clip: str, hold: str, duration: str, score: str) -> DataFrame:
    """SCO22, SCO23: clip, the score of its longest scored hold that is no other view, and whether all scored holds are."""
    seen = scores.join(views, [clip, hold], "left").where(F.col(score).isNotNull())
    other = F.coalesce(F.col("view") == NOT_SIDE, F.lit(False))
    best = F.min(F.when(~other, F.struct((-F.col(duration)).alias("d"), F.col(hold).alias("h"), F.col(score).alias("s"))))
    return seen.groupBy(clip).agg(best.alias("_b"), F.bool_and(other).alias("not_side_only")).select(clip, F.col("_b.s").alias("side_score"), "not_side_only")


def fails_tolerance(value: Column, threshold: Column, side: Column) -> Column:
    """AGG7: outside a target that has one side or either; an unmeasured value fails nothing."""
    out = F.when(side == "either", F.abs(value) > threshold).when(side == "below", value < threshold).otherwise(value > threshold)
    return F.coalesce(out, F.lit(False))


def median_finite(x: Column | str) -> Column:
    """AGG11: the median of what is known; null if nothing is."""
    x = F.col(x) if isinstance(x, str) else x
    return F.percentile(F.when(~F.isnan(x.cast("double")), x), F.lit(0.5))


def measurable(hold: Column, valid: Column) -> Column:
    """AGG35: in a hold and valid."""
    return F.coalesce(hold.isNotNull() & valid, F.lit(False))


def hold_durations(frames: DataFrame, keys: list[str], hold: str, time: str) -> DataFrame:
    """AGG36: keys, hold and its span."""
    return frames.where(F.col(hold).isNotNull()).groupBy(*keys, hold).agg((F.max(time) - F.min(time)).alias("duration"))


def clip_stats(frames: DataFrame, clip: str, hold: str, time: str, valid: str, feature: str) -> DataFrame:
    """AGG6: frames, valid frames, holds, hold frames, measured ones, the longest hold, its span and its median of a feature."""
    ok = F.coalesce(valid, F.lit(False))
    in_hold = F.col(hold).isNotNull()
    each = frames.groupBy(clip, hold).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), (F.max(time) - F.min(time)).alias("span"), F.percentile(F.when(ok, F.col(feature)), F.lit(0.5)).alias("median")
    )
    longest = F.min(F.when(in_hold, F.struct((-F.col("span")).alias("s"), F.col(hold).alias("h"), F.col("median").alias("m"))))
    out = each.groupBy(clip).agg(
        F.sum("n").alias("frames"), F.sum("n_valid").alias("valid_frames"), F.count_if(in_hold).alias("hold_count"), F.coalesce(F.sum(F.when(in_hold, F.col("n"))), F.lit(0)).alias("hold_frames"),
        F.coalesce(F.sum(F.when(in_hold, F.col("n_valid"))), F.lit(0)).alias("measured_hold_frames"), longest.alias("_l"),
    )
    return out.select("*", F.col("_l.h").alias("longest_hold"), F.coalesce(-F.col("_l.s"), F.lit(0.0)).alias("longest_s"), F.col("_l.m").alias("longest_median")).drop("_l")


def segment_stats(segments: DataFrame, frames: DataFrame, keys: list[str], time: str, valid: str, features: list[str]) -> DataFrame:
    """SEG13: ``segments`` (keys, segment_id, shape, start, end) with mixed, frame counts, span, and median and spread of each feature.

    Segments of a hold do not overlap, so a frame meets those of its hold only.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    marked = segments.withColumn("mixed", several)
    at = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys] + [F.col(f"f.{time}").between(F.col("s.start"), F.col("s.end"))]
    ok = F.coalesce(F.col(f"f.{valid}"), F.lit(False))
    quantile = lambda c, q: F.percentile(F.when(ok, F.col(f"f.{c}")), F.lit(q))
    aggs = [F.count(F.col(f"f.{time}")).alias("segment_frames"), F.count_if(ok).alias("valid_frames")]
    for c in features:
        aggs += [quantile(c, 0.5).alias(f"{c}_median"), (quantile(c, 0.75) - quantile(c, 0.25)).alias(f"{c}_iqr")]
    own = [*keys, "segment_id", "shape", "mixed", "start", "end"]
    found = marked.alias("s").join(frames.alias("f"), at, "left").groupBy(*(F.col(f"s.{c}") for c in own)).agg(*aggs)
    return found.withColumn("duration", F.col("end") - F.col("start"))


def segment_report(segments: DataFrame, labels: DataFrame | None, keys: list[str]) -> DataFrame:
    """AGG23: shape, segments, mixed ones, seconds and, of the reviewed, how many the review agrees with."""
    found = segments if labels is None else segments.join(labels.select(*keys, F.col("shape").alias("reviewed")), keys, "left")
    reviewed = F.lit(None).cast("string") if labels is None else F.col("reviewed")
    return found.groupBy("shape").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("mixed").alias("mixed"), F.sum("duration").alias("seconds"), F.count(reviewed).alias("reviewed"), F.count_if(reviewed == F.col("shape")).alias("agreed")
    )


def extremes(scores: DataFrame, score: str, order: list[str], n: int = 5) -> DataFrame:
    """SCO7: the best and the worst rows (end, place); ties by ``order``. A top-k report: two small sorts."""
    known = scores.where(F.col(score).isNotNull())
    out = None
    for end, first in (("best", F.col(score).desc()), ("worst", F.col(score).asc())):
        top = known.orderBy(first, *order).limit(n)
        top = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(end)).orderBy(first, *order))).withColumn("end", F.lit(end))
        out = top if out is None else out.unionByName(top)
    return out


def ranked(stats: DataFrame, value: str, order: list[str], n: int = 5, largest: bool = True, absolute: bool = False) -> DataFrame:
    """SCO11, SCO12: the n rows of largest (or smallest) value, or absolute value; ties by ``order``."""
    by = F.abs(value) if absolute else F.col(value)
    return stats.where(F.col(value).isNotNull()).orderBy(by.desc() if largest else by.asc(), *order).limit(n)


def labelled_side(joints: DataFrame, keys: list[str], joint: str = "joint") -> DataFrame:
    """AGG34: keys and side: the one side that has labelled joints; null for both or neither."""
    left, right = F.bool_or(F.startswith(joint, F.lit("left_"))), F.bool_or(F.startswith(joint, F.lit("right_")))
    return joints.groupBy(*keys).agg(F.when(left & ~right, "left").when(right & ~left, "right").alias("side"))


def label_sides(frames: DataFrame, keys: list[str], human: Column, rule: Column, visible: Column, deep: Column) -> DataFrame:
    """AGG26: keys, the four readings of the near side, and which of the last three agree with the first (null if it or they are unknown)."""
    own = frames.select(*keys, human.alias("human"), rule.alias("rule"), visible.alias("vis"), deep.alias("z"))
    return own.withColumns({f"{c}_agrees": F.col(c) == F.col("human") for c in ("rule", "vis", "z")})


def hold_sides(frames: DataFrame, keys: list[str], votes: list[str]) -> DataFrame:
    """AGG27: keys, frames, the majority of each reading (left on a tie) and how many of its frames read otherwise."""
    aggs = [F.count(F.lit(1)).alias("frames")]
    for v in votes:
        left, right = F.count_if(F.col(v) == "left"), F.count_if(F.col(v) == "right")
        aggs += [F.when(left + right > 0, F.when(left >= right, "left").otherwise("right")).alias(f"{v}_side"), F.least(left, right).alias(f"{v}_against")]
    return frames.groupBy(*keys).agg(*aggs)


def labelled_frames(labels: DataFrame, clip: str, frame: str, automatic: DataFrame, missing: DataFrame) -> DataFrame:
    """BAK1: a row a labelled frame: image, n_joints, human (not labelled by machine), missing_clip and keep."""
    found = labels.groupBy(clip, frame).agg(F.count(F.lit(1)).alias("n_joints"))
    found = found.withColumn("image", F.concat(F.col(clip).cast("string"), F.lit("_"), F.col(frame).cast("string"), F.lit(".jpg")))
    found = found.join(automatic.select("image").distinct().withColumn("_a", F.lit(True)), "image", "left")
    found = found.join(missing.select(clip).distinct().withColumn("_m", F.lit(True)), clip, "left")
    human, gone = F.col("_a").isNull(), F.col("_m").isNotNull()
    return found.select(clip, frame, "image", "n_joints", human.alias("human"), gone.alias("missing_clip"), (human & ~gone).alias("keep"))


def annotated_frames(frames: DataFrame, facts: list[tuple[DataFrame, list[str], dict[str, str]]]) -> DataFrame:
    """BAK2: ``frames`` with facts of other tables: each is (table, keys, {column: value where there is none})."""
    for table, keys, columns in facts:
        frames = frames.join(table.select(*keys, *columns), keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in columns.items()})
    return frames


def snapshot(rows: DataFrame) -> DataFrame:
    """AGG20: totals of clips compared (compared, fixed, broken, moved), and shares weighted by their frames."""
    moved = F.col("moved")
    return rows.agg(
        F.count(F.lit(1)).alias("clips"), F.sum("compared").alias("compared"), F.sum("fixed").alias("fixed"), F.sum("broken").alias("broken"), F.count_if(moved > 0).alias("better"), F.count_if(moved < 0).alias("worse"),
        F.count_if(moved == 0).alias("unchanged"), F.count_if(F.abs(moved) > 10).alias("moved_ten_points"), (100 * F.sum("inverted") / F.sum("detected")).alias("inverted_percent"),
    )


def chain_snapshot(clips: DataFrame, holds: DataFrame, usable: str, frames: str, trainer: str, clip: str, duration: str) -> DataFrame:
    """AGG21: usable clips, their frames, clips with a hold, seconds in holds and clips with a trainer."""
    ok = F.coalesce(usable, F.lit(False))
    first = clips.agg(F.count_if(ok).alias("usable_clips"), F.sum(F.when(ok, F.col(frames))).alias("frames"), F.count_if(F.coalesce(trainer, F.lit(False))).alias("trainer_clips"))
    return first.crossJoin(holds.agg(F.countDistinct(clip).alias("hold_clips"), F.sum(duration).alias("hold_s")))  # one row by one row


def cleaning_summary(reports: DataFrame) -> DataFrame:
    """PP14: sums of samples, their valid share, and exact medians over clips of jitter and length."""
    jitter, length = (exact_quantiles(reports, c, [0.5])[0] for c in ("jitter", "length"))
    sums = reports.agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"), (100 * F.sum("valid") / F.sum("total")).alias("valid_percent"), F.count_if(F.col("length").isNull()).alias("unusable"))
    return sums.withColumns({"jitter_median": F.lit(jitter).cast("double"), "length_median": F.lit(length).cast("double")})


def holds_per_clip(holds: DataFrame, wanted: DataFrame, clip: str) -> DataFrame:
    """ING17: the wanted clips and their numbers of holds; 0 where there is none."""
    counts = holds.groupBy(clip).agg(F.count(F.lit(1)).alias("holds"))
    return wanted.select(clip).distinct().join(counts, clip, "left").withColumn("holds", F.coalesce("holds", F.lit(0)))


def flag_clips(catalogue: DataFrame, clips: DataFrame, clip: str, notes: str, word: str) -> DataFrame:
    """ING15: ``catalogue`` with a word at the end of the notes of some clips, once."""
    marked = catalogue.join(clips.select(clip).distinct().withColumn("_f", F.lit(True)), clip, "left")
    own = F.coalesce(notes, F.lit(""))
    there = F.array_contains(F.transform(F.split(own, ";"), lambda x: F.trim(x)), word)
    new = F.when(F.col("_f").isNotNull() & ~there, F.when(own == "", F.lit(word)).otherwise(F.concat(own, F.lit("; " + word)))).otherwise(own)
    return marked.withColumn(notes, new).drop("_f")


def catalogue_order(rows: DataFrame, recorded: str, name: str) -> DataFrame:
    """ING8: by time of recording, then name."""
    return rows.orderBy(recorded, name)
