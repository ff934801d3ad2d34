"""Taking in new recordings: what each file is, by content, and what the catalogue says of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text


def is_clip(name: Column) -> Column:
    """ING1."""
    return F.lower(name).endswith(".mp4")


def plan_inbox(inbox: DataFrame, catalogue: DataFrame, placed: DataFrame) -> DataFrame:
    """ING2-4: name, clip_id, target and reason of every clip of ``inbox`` (name, clip_id).

    ``catalogue`` has clip_id; ``placed`` has the name and clip_id of recordings in place. The first
    file of a content, by name, is new; its target follows the naming rule and, where other content has that
    name, takes the smallest free suffix.
    """
    clips = inbox.where(is_clip(F.col("name"))).select("name", "clip_id")
    known = catalogue.where("clip_id <> ''").select(F.col("clip_id").alias("_k")).distinct()
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy("name"))
    first = F.first("name").over(Window.partitionBy("clip_id").orderBy("name"))
    ranked = clips.withColumns({"_r": rank, "_first": first, "target": text.take_name(F.col("name"))}).join(known, F.col("clip_id") == F.col("_k"), "left")
    there = placed.select(F.col("name").alias("target"), F.col("clip_id").alias("_there"))
    ranked = ranked.join(there, "target", "left")
    reason = (
        F.when(F.col("_k").isNotNull(), "already in the catalogue")
        .when(F.col("_there") == F.col("clip_id"), F.concat(F.lit("identical to "), F.col("target"), F.lit(" in place")))
        .when(F.col("_r") > 1, F.concat(F.lit("identical to "), F.col("_first"), F.lit(" in this inbox")))
        .otherwise("")
    )
    planned = ranked.withColumn("reason", reason)
    # free names: suffixes that are taken, by what stands before them
    suffix = r"^(.*?)(?: \(ingest (\d+)\))?(\.[^.]+)$"
    taken = placed.select(F.concat(F.regexp_extract("name", suffix, 1), F.regexp_extract("name", suffix, 3)).alias("target"), F.regexp_extract("name", suffix, 2).try_cast("int").alias("n"))
    taken = taken.where("n is not null").groupBy("target").agg(F.collect_set("n").alias("_used"))
    planned = planned.join(taken, "target", "left")
    collides = (F.col("reason") == "") & F.col("_there").isNotNull()
    used = F.coalesce("_used", F.array().cast("array<int>"))
    nth = F.row_number().over(Window.partitionBy("target", collides).orderBy("name"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.size(used) + nth), used))
    renamed = F.concat(F.regexp_extract("target", suffix, 1), F.lit(" (ingest "), F.get(free, nth - 1).cast("string"), F.lit(")"), F.regexp_extract("target", suffix, 3))
    return planned.withColumn("_t", F.when(collides, renamed).otherwise(F.col("target"))).select("name", "clip_id", F.when(F.col("reason") == "", F.col("_t")).alias("target"), "reason")


def summary(catalogue: DataFrame) -> DataFrame:
    """ING12: one row of counts: present, missing, variable rate, turned and dated clips."""
    n = lambda c: F.count(F.when(c, 1))
    here = ~F.coalesce("missing", F.lit(False))
    return catalogue.agg(
        n(here).alias("present"), n(~here).alias("missing"), n(here & text.variable_frame_rate(F.col("fps_avg"), F.col("fps_nominal"))).alias("variable_rate"),
        n(here & (F.pmod("rotation", F.lit(360)) != 0)).alias("turned"), n(here & (F.coalesce("recorded_at", F.lit("")) != "")).alias("dated"),
    )


def good_clips(reviews: DataFrame) -> DataFrame:
    """ING14: clip_id and good_clip: whether a reviewed hold is a yes that is not at a wall."""
    return reviews.groupBy("clip_id").agg(F.bool_or(F.coalesce(F.col("yes") & ~F.coalesce("wall", F.lit(False)), F.lit(False))).alias("good_clip"))


def trainer_present(histogram: Column, contact_frames: Column) -> Column:
    """ING18: two people or more in some frame, or contact."""
    crowd = F.exists(F.map_entries(histogram), lambda e: (e["key"] >= 2) & (e["value"] > 0))
    return F.coalesce(crowd, F.lit(False)) | F.coalesce(contact_frames > 0, F.lit(False))


def overwrite_skill(catalogue: DataFrame, skills: DataFrame) -> DataFrame:
    """ING16: ``catalogue`` with the skill of clips that have one; others as they are."""
    new = skills.select(F.col("clip_id").alias("_k"), F.col("skill").alias("_s"))
    joined = catalogue.join(new, F.col("clip_id") == F.col("_k"), "left")
    return joined.withColumn("skill", F.coalesce("_s", "skill")).select(*catalogue.columns)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], settings: str) -> DataFrame:
    """ORC4, ORC5: work whose output is missing or was made with other settings."""
    made = done.select(*keys, F.col(settings).alias("_s"))
    joined = wanted.join(made, keys, "left")
    return joined.where(~F.col(settings).eqNullSafe(F.col("_s"))).drop("_s")
