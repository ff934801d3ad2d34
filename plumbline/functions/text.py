"""Names, flags and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how recorders name their files.
STAMP = r"(\d{4}-\d{2}-\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2}) (AM|PM)"


def hour24(hour: Column, meridiem: Column) -> Column:
    """STR2: an hour of a 12-hour clock; null when it is none."""
    return F.when(hour.between(1, 12), hour % 12 + F.when(meridiem == "PM", 12).otherwise(0))


def recorded_at(name: Column) -> Column:
    """STR1: the ISO time in a file name, empty when there is none or it cannot be."""
    part = lambda i: F.regexp_extract(name, STAMP, i)
    hour = hour24(part(2).try_cast("int"), part(5))
    text = F.concat(part(1), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(3), F.lit(":"), part(4))
    return F.when(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), text).otherwise("")


def lenient_bool(value: Column) -> Column:
    """STR3: whether the text says true."""
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def strict_bool(value: Column, column: str) -> Column:
    """STR4: true or false; anything else ends the query."""
    v = F.lower(F.trim(value))
    return F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit(f"{column} holds neither true nor false: "), F.coalesce(value, F.lit("null")))).cast("boolean"))


def hold_key(value: Column) -> Column:
    """STR5: one key for a hold written as 2 or 2.0; other text trimmed."""
    number = F.trim(value).try_cast("double")
    whole = F.when(~F.isnan(number) & (F.abs(number) < 9e18), number.cast("bigint").cast("string"))
    return F.coalesce(whole, F.trim(value))


def segment_key(clip: Column, hold: Column, segment: Column) -> Column:
    """STR6."""
    return F.concat(clip, F.lit("_h"), hold.cast("string"), F.lit("_s"), segment.cast("string"))


def image_name(clip: Column, frame: Column) -> Column:
    """STR7."""
    return F.concat(clip, F.lit("_"), frame.cast("string"), F.lit(".jpg"))


def parse_image_name(name: Column) -> Column:
    """STR8: struct of clip_id and frame_idx; null when the name is not one of ours."""
    pattern = r"([^/\\]+)_(\d+)\.jpg$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("clip_id"), F.regexp_extract(name, pattern, 2).cast("bigint").alias("frame_idx")))


def append_note(notes: Column, word: str) -> Column:
    """STR9: the notes with the word, added once."""
    have = F.coalesce(notes, F.lit(""))
    return F.when(F.instr(F.lower(have), word.lower()) > 0, have).when(F.trim(have) == "", F.lit(word)).otherwise(F.concat(have, F.lit("; "), F.lit(word)))


def split_list(value: Column) -> Column:
    """STR13: the entries of a semicolon list, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def segment_times(start_ms: Column, end_ms: Column) -> Column:
    """STR11: quarter times of a segment; only its middle when it is short."""
    span = F.greatest(end_ms - start_ms, F.lit(0))
    at = lambda share: F.bround(start_ms + span * share).cast("bigint")
    return F.when(span < 300, F.array(at(0.5))).otherwise(F.array(at(0.25), at(0.5), at(0.75)))


def normalised_joint(label: Column) -> Column:
    """LAB3: a joint name in lower case with single underscores."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[\s\-.]+", "_"), "_+", "_")
    return F.nullif(F.trim(text, F.lit("_")), F.lit(""))


def keypoint_visible(visible: Column, visibility: Column, occluded: Column, unclear: Column) -> Column:
    """LAB5: the first statement that is made counts."""
    return F.coalesce(visible, visibility > 0, ~occluded, ~unclear, F.lit(True))


def content_id(content: Column, length: int = 12) -> Column:
    """ING5: identity by content."""
    return F.substring(F.sha1(content), 1, length)


def take_name(name: Column) -> Column:
    """ING3: a copy marked (N) becomes take N+1."""
    n = F.regexp_extract(name, r" ?\((\d+)\)(\.[^.]+)$", 1)
    renamed = F.concat(F.regexp_replace(name, r" ?\(\d+\)(\.[^.]+)$", ""), F.lit(" take"), (n.try_cast("int") + 1).cast("string"), F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.when(n != "", renamed).otherwise(name)


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    """ING9: struct of width and height as shown."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def parse_frame_rate(value: Column) -> Column:
    """ING11: a number or a fraction; null when it is neither or divides by 0."""
    parts = F.split(value, "/")
    top, bottom = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    rate = F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, bottom))
    return F.when(rate > 0, rate)


def variable_frame_rate(average: Column, nominal: Column, tolerance: float = 0.005) -> Column:
    """ING10."""
    return F.coalesce((nominal > 0) & (F.abs(average - nominal) / nominal > tolerance), F.lit(False))
