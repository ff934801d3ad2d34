"""Order over a whole table without a single task: running totals by ranges, and exact quantiles in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settled


def running_totals(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``total_`` of each value: its sum over all rows up to this one in the order, which must tell rows apart.

    Rows are dealt by ranges of the order; each range is summed by itself and shifted by the sums of those before it, of which
    there is a row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order)
    inside = dealt.withColumns({f"total_{v}": F.sum(v).over(w) for v in values})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    shifts = sums.select("_part", *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values))
    out = inside.join(F.broadcast(shifts), "_part")
    return out.withColumns({f"total_{v}": F.col(f"total_{v}") + F.col(f"_b_{v}") for v in values}).drop("_part", *(f"_b_{v}" for v in values))


def exact_quantiles(df: DataFrame, column: str, shares: list[float], cells: int = 4096) -> list[float | None]:
    """Linearly interpolated quantiles of a column's known values, by selection in rounds.

    A round counts the values of each open range in ``cells`` equal cells and keeps, for every rank still sought, the cell that
    holds it; values that all lie in one cell of no width are the answer. What a task or the driver holds is a number a cell: no task
    sees the column sorted or whole. Doubles separate after a handful of rounds.
    """
    x = F.col(column).cast("double")
    known = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    n, low, high = known.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    wanted = sorted({r for q in shares for r in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))})
    found: dict[int, float] = {}
    # (low, high, values below low, ranks sought inside)
    ranges = [(low, high, 0, wanted)]
    while ranges:
        for a, b, _, ranks in ranges:
            if a == b:
                found.update(dict.fromkeys(ranks, a))
        ranges = [r for r in ranges if r[0] < r[1]]
        if not ranges:
            break
        cell = F.lit(None).cast("long")
        for i, (a, b, _, _) in enumerate(ranges):
            width = (b / 2 - a / 2) / cells * 2
            inner = F.greatest(F.lit(1), F.least(F.lit(cells - 2), F.floor((F.col("x") - a) / width))) if width > 0 else F.lit(1)
            # the ends have cells of their own, so that every round tells some values apart
            at = F.when(F.col("x") <= a, 0).when(F.col("x") >= b, cells - 1).otherwise(inner)
            cell = F.when((F.col("x") >= a) & (F.col("x") <= b), i * cells + at).otherwise(cell)
        counted = known.select("x", cell.alias("c")).where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        rows = sorted(counted.collect(), key=lambda r: r["c"])  # at most a row a cell
        nearer = []
        for i, (a, b, below, ranks) in enumerate(ranges):
            for r in rows:
                if r["c"] // cells != i:
                    continue
                inside = [k for k in ranks if below <= k < below + r["n"]]
                if inside:
                    nearer.append((r["low"], r["high"], below, inside))
                below += r["n"]
        ranges = nearer
    out = []
    for q in shares:
        at = q * (n - 1)
        lower = int(at)
        upper = min(lower + 1, n - 1)
        out.append(found[lower] + (found[upper] - found[lower]) * (at - lower))
    return out
