"""Keyed upkeep of tables: replacing, merging, importing labels and telling copies apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_keys(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """BAK22, LAB13: rows of the keys in ``fresh`` replaced, all others kept."""
    kept = existing.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_dimension(existing: DataFrame, fresh: DataFrame, key: str, measured: list[str], owned: list[str]) -> DataFrame:
    """ING7: fresh measurements win, owned columns stay, rows that are gone stay as ``missing``; rows without a key stay as they are."""
    old = existing.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in measured + owned))
    new = fresh.select(F.col(key).alias("_f"), *measured)
    both = new.join(old, F.col("_f") == F.col("_k"), "full_outer")
    here = F.col("_f").isNotNull()
    merged = both.select(
        F.coalesce("_f", "_k").alias(key),
        *(F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in measured),
        *(F.col(f"_{c}").alias(c) for c in owned),
        (~here).alias("missing"),
    )
    blank = existing.where(F.col(key).isNull()).select(key, *measured, *owned, F.lit(False).alias("missing"))
    return merged.unionByName(blank)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """LAB2, LAB6-8: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def import_labels(existing: DataFrame, labels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """LAB2: the table after the import, with what happened to each row: added, updated, unchanged or kept."""
    old = existing.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(v).alias(f"_{v}") for v in values))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = labels.select(*keys, *values, F.lit(True).alias("_new")).join(old.withColumn("_old", F.lit(True)), on, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    picked = [F.when(F.col("_new").isNull(), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return both.select(*(F.when(F.col("_new").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)), *picked, change.alias("change"))


def first_of_content(rows: DataFrame, content: Column, order: list[str], length: int = 12) -> DataFrame:
    """ING2, ING5: ``rows`` with content_id and ``copy_of``: null for the first of a content, else the first one's order columns."""
    hashed = rows.withColumn("content_id", F.substring(F.sha1(content), 1, length))
    first = hashed.groupBy("content_id").agg(F.min(F.struct(*order)).alias("first"))
    joined = hashed.join(first, "content_id")
    mine = F.struct(*order)
    return joined.withColumn("copy_of", F.when(mine != F.col("first"), F.col("first"))).drop("first")


def fill_empty(existing: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """ING13: empty cells of the columns take the facts'; what a person wrote stays."""
    known = facts.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = existing.join(known, F.col(key) == F.col("_k"), "left")
    new = {c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*existing.columns)


def pick_evenly(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """ING19: at most n rows of each key, evenly spaced, the first and the last among them."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    chosen = F.when(F.col("_n") <= n, F.lit(True)).otherwise(F.array_contains(at, F.col("_i").cast("long")))
    return ranked.where(chosen).drop("_i", "_n")
