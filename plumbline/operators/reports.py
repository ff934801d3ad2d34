"""Roll-ups for people: clips with a trainer, readings compared, shapes, progress and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import runs, timeops
from plumbline.operators.orders import exact_quantiles


def clip_report(frames: DataFrame, keys: list[str], time: str, tie: str, second: str, contact: str, detected: str, present_s: float = 0.5) -> DataFrame:
    """AGG15: per clip, frames and time with a second person, contact and its longest run, and whether a trainer is there."""
    timed = timeops.frame_durations(frames, keys, time, tie)
    contacts = runs.flagged_time(timed, keys, [time, tie], contact, "duration").select(*keys, F.col("longest").alias("longest_contact"))
    counts = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(F.col(second), 1)).alias("second_person_frames"),
        F.coalesce(F.sum(F.when(F.col(second), F.col("duration"))), F.lit(0.0)).alias("second_person_time"),
        F.count(F.when(F.col(contact), 1)).alias("contact_frames"),
        F.count(F.when(F.col(detected), 1)).alias("athlete_frames"),
    )
    return counts.join(contacts, keys).withColumn("trainer_present", F.col("second_person_time") >= present_s)


def compare_readings(frames: DataFrame, keys: list[str], before: Column, after: Column, truth: Column) -> DataFrame:
    """AGG19: per clip, frames that both read, those the new reading put right, and those it broke."""
    both = before.isNotNull() & after.isNotNull()
    return frames.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("compared"),
        F.count(F.when(both & (before != truth) & (after == truth), 1)).alias("fixed"),
        F.count(F.when(both & (before == truth) & (after != truth), 1)).alias("broken"),
    )


def inverted_share(inverted: str, detected: str) -> Column:
    """AGG18: percent of detected frames that are inverted."""
    return 100 * F.avg(F.when(F.col(detected), F.col(inverted).cast("double")))


def clip_skills(labels: DataFrame, clip: str, shape: str, excluded: tuple[str, ...] = ("not_a_hold",)) -> DataFrame:
    """AGG22: clip and skill: the one shape of its reviewed holds, or mixed."""
    shapes = labels.where(F.col(shape).isNotNull() & ~F.col(shape).isin(*excluded)).groupBy(clip).agg(F.min(shape).alias("lo"), F.max(shape).alias("hi"))
    return shapes.select(clip, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("skill"))


def agreement(labels: DataFrame, shape: str, predicted: str, by: list[str]) -> DataFrame:
    """AGG22, AGG24, SHP7: by, holds with a prediction, and those it agrees with the label on."""
    known = F.col(predicted).isNotNull() & (F.col(predicted) != "unmeasured")
    return labels.groupBy(*by).agg(F.count(F.when(known, 1)).alias("predicted"), F.count(F.when(known & (F.col(shape) == F.col(predicted)), 1)).alias("agreed"))


def progress(sessions: DataFrame, user: str, at: str, score: str, now: Column, last: int = 10) -> DataFrame:
    """AGG28: per user, sessions in all and this calendar week, the best score, and the latest ones, oldest first."""
    week = F.date_trunc("week", F.col(at)) == F.date_trunc("week", now)
    recent = F.slice(F.sort_array(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(at, score))), asc=False), 1, last)
    return sessions.groupBy(user).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(week, 1)).alias("this_week"), F.max(score).alias("best"), F.transform(F.reverse(recent), lambda s: s[score]).alias("latest")
    )


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """AGG8, AGG10: one row of exact quantiles of a column's known values, selected in rounds."""
    found = exact_quantiles(df, column, list(at))
    n = df.agg(F.count(F.when(~F.isnan(F.col(column).cast("double")), F.col(column))).alias("n"))
    return n.select(*(F.lit(v).cast("double").alias(f"p{round(100 * q)}") for q, v in zip(at, found, strict=True)), "n")


def diagnostics(frames: DataFrame, keys: list[str], time: str, reason: str) -> DataFrame:
    """AGG30: keys and a JSON document: frames, span, and frames by reason."""
    counts = frames.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    docs = counts.groupBy(*keys).agg(
        F.sum("n").alias("frames"), (F.max("b") - F.min("a")).alias("span"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(reason, F.lit("")), "n")))).alias("reasons")
    )
    return docs.select(*keys, F.to_json(F.struct("frames", "span", "reasons")).alias("document"))


def dataset_report(clips: DataFrame, reasons: tuple[str, ...] = ()) -> DataFrame:
    """AGG17: one row of figures over ``clip_report`` rows (with seconds, dropped_frames, scorable_frames, error and a count for each reason): clips, frames and what becomes of them.

    A clip with an error carries no numbers: it is counted and takes part in no share. Shares are percents, and 0 of nothing.
    """
    fine = F.coalesce(F.col("error"), F.lit("")) == ""
    of = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0))
    counts = ("frames", "second_person_frames", "contact_frames", "dropped_frames", "scorable_frames", "seconds", *reasons)
    trainer = F.coalesce(F.col("trainer_present"), F.lit(False))
    out = clips.agg(F.count(F.lit(1)).alias("clips"), F.count_if(fine).alias("measured"), F.count_if(~fine).alias("failed"), F.count_if(fine & trainer).alias("with_trainer"), *(of(c).alias(c) for c in counts))
    share = lambda n, d: F.when(F.col(d) > 0, 100.0 * F.col(n) / F.col(d)).otherwise(0.0)
    shares = {"pct_with_trainer": share("with_trainer", "measured"), "pct_clean": share("clean", "measured")}
    shares |= {f"pct_{c}": share(f"{c}_frames", "frames") for c in ("second_person", "contact", "dropped", "scorable")}
    return out.withColumn("clean", F.col("measured") - F.col("with_trainer")).withColumns(shares)


def report_clips(clips: DataFrame, most: int = 10) -> DataFrame:
    """AGG17: the clips a report names: the failed ones with their error, and the ``most`` measured ones of the greatest share of contact; ties go to the longest run of it, then to the lesser id."""
    fine = F.coalesce(F.col("error"), F.lit("")) == ""
    share = F.when(F.col("frames") > 0, 100.0 * F.col("contact_frames") / F.col("frames")).otherwise(0.0)
    worst = clips.where(fine).select("clip_id", F.lit("affected").alias("why"), share.alias("pct_contact"), F.lit(None).cast("string").alias("error"), "longest_contact").orderBy(F.desc("pct_contact"), F.desc("longest_contact"), "clip_id").limit(most)
    failed = clips.where(~fine).select("clip_id", F.lit("failed").alias("why"), F.lit(None).cast("double").alias("pct_contact"), F.col("error").cast("string").alias("error"))
    return worst.drop("longest_contact").unionByName(failed)
