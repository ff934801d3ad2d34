"""Runs and phases: run-length encoding, holds, the phase automaton and segment merging."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.timeops import in_order


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """``df`` with a number that grows where the value changes (nulls equal each other)."""
    w = in_order(keys, *order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(F.lag(value).over(w).eqNullSafe(value), 0).otherwise(1))
    df = df.withColumn("_c", changed)
    return df.withColumn(name, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """SEG4-6: keys, run, value, rows, start and end of every run."""
    runs = run_ids(df, keys, order, F.col(value))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("rows"), F.min(time).alias("start"), F.max(time).alias("end"))


def change_counts(df: DataFrame, keys: list[str], order: list[str], value: str, short: int = 3) -> DataFrame:
    """SEG7, SEG8: keys, runs, changes and runs of at most ``short`` rows."""
    lengths = run_ids(df, keys, order, F.col(value)).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    return lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) - 1).alias("changes"), F.sum(F.when(F.col("n") <= short, 1).otherwise(0)).alias("short_runs")
    )


def changed_runs(df: DataFrame, keys: list[str], order: list[str], first: Column, second: Column) -> DataFrame:
    """SEG9: keys, run and rows of every stretch on which two readings disagree."""
    differ = F.coalesce(first != second, F.lit(False))
    runs = run_ids(df.withColumn("_d", differ), keys, order, F.col("_d"))
    return runs.where("_d").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("rows"))


def flagged_time(df: DataFrame, keys: list[str], order: list[str], flag: str, duration: str) -> DataFrame:
    """SIG8-10: keys, flagged time, the longest flagged run in time and in rows."""
    runs = run_ids(df, keys, order, F.col(flag)).groupBy(*keys, "run", flag).agg(F.sum(duration).alias("t"), F.count(F.lit(1)).alias("n"))
    on = lambda c: F.coalesce(F.max(F.when(F.col(flag), F.col(c))), F.lit(0))
    return runs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(flag), F.col("t"))), F.lit(0.0)).alias("flagged"), on("t").alias("longest"), on("n").alias("longest_rows"))


def hold_runs(df: DataFrame, keys: list[str], time: str, tie: str, holding: str, event: str, min_hold: float, max_break: float) -> DataFrame:
    """SEG1: ``df`` with hold_id (0.. by time, -1 for none).

    Between two holding rows a stretch of others breaks the run if it holds an event or
    lasts longer than ``max_break``. The run then ends before the event, bridged rows included, or
    at its last holding row. Runs shorter than ``min_hold`` are none.
    """
    w = in_order(keys, time, tie)
    df = df.withColumn("_n", F.row_number().over(w))
    df = df.withColumn("_stretch", F.sum(F.col(holding).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of a stretch share the number of holding rows before them; its first row is the holding one
    s = Window.partitionBy(*keys, "_stretch")
    other = ~F.col(holding)
    df = df.withColumn("_from", F.min(F.when(other, F.col(time))).over(s))
    df = df.withColumn("_event", F.min(F.when(other & F.col(event), F.col("_n"))).over(s))
    df = df.withColumn("_over", F.min(F.when(other & (F.col(time) - F.col("_from") > max_break), F.col("_n"))).over(s))
    df = df.withColumn("_broke", F.col("_event").isNotNull() | F.col("_over").isNotNull())
    last = F.when(F.col("_event").isNotNull() & (F.col("_over").isNull() | (F.col("_event") <= F.col("_over"))), F.col("_event") - 1)
    to_here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    on = F.coalesce(F.col(holding), F.lit(False))
    # a run begins with the holding row after a stretch that broke; what is not holding belongs to the run before
    df = df.withColumn("_end", F.when(on, F.coalesce(F.when(F.col("_broke"), last), F.col("_n"))))
    df = df.withColumn("_b", F.when(on, F.coalesce(F.last(F.when(on, F.col("_broke").cast("int")), ignorenulls=True).over(before), F.lit(0))))
    df = df.withColumn("_run", F.coalesce(F.sum("_b").over(to_here), F.lit(0)))
    r = Window.partitionBy(*keys, "_run")
    df = df.withColumns({"_first": F.min(F.when(on, F.col("_n"))).over(r), "_last": F.max("_end").over(r)})
    ends = {f"_t{i}": F.min(F.when(F.col("_n") == F.col(c), F.col(time))).over(r) for i, c in enumerate(("_first", "_last"))}
    df = df.withColumns(ends).withColumn("_long", F.coalesce(F.col("_t1") - F.col("_t0") >= min_hold, F.lit(False)))
    nth = F.count(F.when(F.col("_long") & (F.col("_n") == F.col("_first")), 1)).over(to_here).cast("int") - 1
    hold = F.when(F.col("_long") & F.col("_n").between(F.col("_first"), F.col("_last")), nth)
    return df.withColumn("hold_id", F.coalesce(hold, F.lit(-1))).drop("_n", "_stretch", "_from", "_event", "_over", "_broke", "_end", "_b", "_run", "_first", "_last", "_t0", "_t1", "_long")


def phases(df: DataFrame, keys: list[str], time: str, tie: str, known: str, hands_down: str, rising: str, hands_low: str) -> DataFrame:
    """SEG2: ``df`` (with hold_id) with phase: pre, kickup, hold, exit, post or unknown.

    Every known row sets a marker or keeps the one before: hold; exit right after a hold;
    kickup when the hands are down and the legs rise; down when the hands are not low, which is
    post after any hold or kickup and pre before.
    """
    w = in_order(keys, time, tie)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("hold_id") >= 0
    df = df.withColumn("_was", F.last(F.when(F.col(known), inside), ignorenulls=True).over(before))
    marker = (
        F.when(~F.col(known), F.lit(None))
        .when(inside, "hold")
        .when(F.coalesce("_was", F.lit(False)), "exit")
        .when(F.col(hands_down) & F.col(rising), "kickup")
        .when(~F.col(hands_low), "down")
    )
    df = df.withColumn("_m", marker)
    df = df.withColumn("_seen", F.coalesce(F.max(F.col("_m").isin("hold", "kickup").cast("int")).over(before), F.lit(0)) == 1)
    df = df.withColumn("_m", F.when(F.col("_m") == "down", F.when(F.col("_seen"), "post").otherwise("pre")).otherwise(F.col("_m")))
    carried = F.coalesce(F.last("_m", ignorenulls=True).over(to_here), F.lit("pre"))
    return df.withColumn("phase", F.when(inside, "hold").when(~F.col(known), "unknown").otherwise(carried)).drop("_was", "_m", "_seen")


def merged_runs(runs: list[tuple[str, float, float]], min_length: float) -> list[tuple[str, float, float]]:
    """(label, start, end) of neighbouring runs after the shortest under ``min_length`` has joined its longer neighbour, again and again.

    The earlier run goes first of two equally short ones, and joins the one before where its neighbours are equally long. Runs are
    linked to their neighbours and wait in a heap, so that n runs take n log n steps.
    """
    label, start, end = ([r[i] for r in runs] for i in range(3))
    before, after, gone = list(range(-1, len(runs) - 1)), list(range(1, len(runs) + 1)), [False] * len(runs)
    length = lambda i: end[i] - start[i]
    heap = [(length(i), i) for i in range(len(runs))]
    heapq.heapify(heap)
    left = len(runs)

    def join(i: int, j: int) -> None:
        """j, the neighbour behind i, becomes part of i."""
        end[i], after[i], gone[j] = end[j], after[j], True
        if after[j] < len(runs):
            before[after[j]] = i

    while left > 1 and heap:
        size, i = heapq.heappop(heap)
        if gone[i] or size != length(i):
            continue
        if size >= min_length:
            break
        sides = [j for j in (before[i], after[i]) if 0 <= j < len(runs)]
        to = max(sides, key=lambda j: (length(j), -j))
        first = min(i, to)
        label[first] = label[to]
        join(first, max(i, to))
        left -= 1
        for one, two in ((before[first], first), (first, after[first])):
            if 0 <= one and two < len(runs) and label[one] == label[two]:
                join(one, two)
                left -= 1
                first = one if one < first else first
        heapq.heappush(heap, (length(first), first))
    return [(label[i], start[i], end[i]) for i in range(len(runs)) if not gone[i]]


def merge_short_segments(df: DataFrame, keys: list[str], time: str, label: str, min_length: float, unmeasured: str = "unmeasured", tie: str | None = None) -> DataFrame:
    """SEG11, SEG12: keys, segment_id, label, start and end after short runs joined their longer neighbours.

    A row without a label joins the run in progress (the first labelled run, at the start); rows of one time follow ``tie``, else their
    label. Each merge decides the next, so a key's runs are folded in one task; runs are few where rows are many.
    """
    order = [time, tie or label]
    w = in_order(keys, *order)
    seen = F.when(F.col(label) != unmeasured, F.col(label))
    filled = F.coalesce(
        F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(unmeasured)
    )
    runs = run_lengths(df.withColumn("_l", filled), keys, order, "_l", time)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("run")
        out = pd.DataFrame(merged_runs(list(part[["_l", "start", "end"]].itertuples(index=False, name=None)), min_length), columns=[label, "start", "end"])
        out.insert(0, "segment_id", range(len(out)))
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["segment_id bigint", f"{label} string", f"start {types[time]}", f"end {types[time]}"])
    return runs.groupBy(*keys).applyInPandas(fold, schema)
