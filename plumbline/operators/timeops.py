"""Time series by key: as-of motion, centred windows, gap filling, durations.

A series has key columns, a time column in seconds (double) and a tie-break; time is never the
row number. All of it is window expressions, so a key is one window partition and nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], time: str, lower: str, upper: str) -> str:
    """The OVER clause of a range frame in seconds; bounds are SQL, doubles where they are numbers."""
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} RANGE BETWEEN {lower} AND {upper})"


def in_order(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def gated(x: Column, visibility: Column, usable: Column, least: float = 0.5) -> Column:
    """PP1: whether a sample counts; unknown is no."""
    return F.coalesce(usable & x.isNotNull() & (visibility >= least), F.lit(False))


def window_motion(df: DataFrame, keys: list[str], time: str, x: str, y: str, known: str, scale: float | Column, window_s: float) -> DataFrame:
    """SIG2: ``step`` and ``speed`` against the last row at or before ``time - window_s``."""
    frame = over(keys, time, "UNBOUNDED PRECEDING", f"{window_s}D PRECEDING")
    df = df.withColumn("_then", F.expr(f"last_value(struct({time} AS t, {x} AS x, {y} AS y, {known} AS k)) {frame}"))
    elapsed = F.col(time) - F.col("_then.t")
    usable = F.col(known) & F.col("_then.k") & (elapsed > 0)
    step = F.when(usable, F.hypot(F.col(x) - F.col("_then.x"), F.col(y) - F.col("_then.y")) / scale)
    return df.withColumn("step", step).withColumn("speed", F.col("step") / elapsed).drop("_then")


def centred_velocity(df: DataFrame, keys: list[str], time: str, x: str, known: str, span_s: float) -> DataFrame:
    """SIG3: ``velocity`` between the nearest rows half a span away on either side, clipped to the series' ends."""
    half = span_s / 2 - 1e-9
    value = f"struct({time} AS t, {x} AS x, {known} AS k)"
    whole = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    df = df.withColumns(
        {
            "_a": F.expr(f"coalesce(last_value({value}) {over(keys, time, 'UNBOUNDED PRECEDING', f'{half}D PRECEDING')}, first_value({value}) {whole})"),
            "_b": F.expr(f"coalesce(first_value({value}) {over(keys, time, f'{half}D FOLLOWING', 'UNBOUNDED FOLLOWING')}, last_value({value}) {whole})"),
        }
    )
    elapsed = F.col("_b.t") - F.col("_a.t")
    usable = F.col(known) & F.col("_a.k") & F.col("_b.k") & (elapsed > 0)
    return df.withColumn("velocity", F.when(usable, (F.col("_b.x") - F.col("_a.x")) / elapsed)).drop("_a", "_b")


def centred_mean(df: DataFrame, keys: list[str], time: str, x: str, window_s: float) -> DataFrame:
    """ORI6: ``smoothed``, the mean of the known values half a window to either side."""
    return df.withColumn("smoothed", F.expr(f"avg({x}) {over(keys, time, f'{window_s / 2}D PRECEDING', f'{window_s / 2}D FOLLOWING')}"))


def fill_gaps(df: DataFrame, keys: list[str], time: str, tie: str, values: list[str], valid: str, max_gap_s: float) -> DataFrame:
    """PP6: invalid rows between valid neighbours at most a gap apart take linear values, become valid and ``filled``."""
    sample = F.when(F.col(valid), F.struct(F.col(time).alias("t"), *(F.col(v).alias(v) for v in values)))
    w = in_order(keys, time, tie)
    df = df.withColumn("_p", F.last(sample, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_n", F.first(sample, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = F.col("_n.t") - F.col("_p.t")
    filled = F.coalesce(~F.col(valid) & (gap > 0) & (gap <= max_gap_s), F.lit(False))
    share = (F.col(time) - F.col("_p.t")) / gap
    new = {v: F.when(filled, F.col(f"_p.{v}") + (F.col(f"_n.{v}") - F.col(f"_p.{v}")) * share).otherwise(F.col(v)) for v in values}
    return df.withColumns({**new, valid: F.col(valid) | filled, "filled": filled}).drop("_p", "_n")


def median_jitter(df: DataFrame, keys: list[str], time: str, tie: str, x: str, y: str, valid: str, scale: float) -> DataFrame:
    """PP12: keys and ``jitter``, the median step between neighbours that are both valid, over the scale."""
    w = in_order(keys, time, tie)
    before = {"_x": F.lag(x).over(w), "_y": F.lag(y).over(w), "_v": F.lag(valid).over(w)}
    step = F.when(F.col(valid) & F.col("_v"), F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")) / scale)
    return df.withColumns(before).groupBy(*keys).agg(F.median(step).alias("jitter"))


def frame_durations(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """SIG7: ``duration``, the time to the next row; the median of those that are positive where there is none."""
    gap = F.lead(time).over(in_order(keys, time, tie)) - F.col(time)
    df = df.withColumn("_gap", F.when(gap > 0, gap))
    return df.withColumn("duration", F.coalesce("_gap", F.median("_gap").over(Window.partitionBy(*keys)))).drop("_gap")


def monotone_times(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """SRC1: whole times made strictly increasing, each at least one more than the one before."""
    w = in_order(keys, tie)
    n = F.row_number().over(w)
    return df.withColumn(time, F.max(F.col(time) - n).over(w.rowsBetween(Window.unboundedPreceding, 0)) + n)


def rate_per_second(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """SIG11: keys and ``rate``, rows a second between the first and the last."""
    span = F.max(time) - F.min(time)
    return df.groupBy(*keys).agg(F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("rate"))


def nearest_rows(df: DataFrame, keys: list[str], time: str, tie: str, wanted: DataFrame, at: str) -> DataFrame:
    """LAB10-12: for each wanted (keys, at) the row nearest in time, the earlier on a tie.

    The nearest row is the last at or before or the first after, so both series are merged
    in one window instead of joined pair by pair.
    """
    row = F.struct(*(F.col(c).alias(c) for c in df.columns if c not in keys))
    merged = df.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_w"), F.col(tie).alias("_tie"), row.alias("_row")).unionByName(
        wanted.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_w")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_w", "_tie")
    merged = merged.withColumn("_p", F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.withColumn("_n", F.first("_row", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before, after = F.col("_t") - F.col(f"_p.{time}"), F.col(f"_n.{time}") - F.col("_t")
    best = F.when(F.col("_n").isNull() | (before <= after), F.col("_p")).otherwise(F.col("_n"))
    return merged.where("_w = 1").select(*keys, F.col("_t").alias(at), best.alias("_b")).select(*keys, at, "_b.*")
