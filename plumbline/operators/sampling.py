"""Stratified sampling of frames: the pool and what left it, strata, quotas, time bins, spacing, budgets and swaps.

A pool has a row a frame: clip_id, frame_idx, t_ms, the clip's start_ms and end_ms, stratum, session_date and inverted.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.orders import running_totals
from plumbline.session import settled

# Strata in order, their shares, frames of a clip at most, their least distance, and the least share of holds.
STRATA = ("clean_no_trainer", "clean_trainer", "trainer_contact")
SHARES = (0.6, 0.25, 0.15)
PER_CLIP, SPACING_MS, INVERTED_SHARE = 4, 500, 0.7
NOT_SAMPLED = "walk"


def stratum(detected: Column, contact: Column, trainer_present: Column) -> Column:
    """SMP2: null for a frame without a person."""
    return F.when(~detected, F.lit(None)).when(contact, "trainer_contact").when(trainer_present, "clean_trainer").otherwise("clean_no_trainer")


def quotas(n: int, shares: tuple[float, ...] = SHARES) -> list[int]:
    """SMP3: floors of the shares of n; what is left goes to the larger shares, one each."""
    if n < 0:
        raise ValueError(f"n is {n}; it cannot be negative")
    out = [math.floor(n * s) for s in shares]
    for i in sorted(range(len(shares)), key=lambda i: (-shares[i], i))[: n - sum(out)]:
        out[i] += 1
    return out


def in_bin_order(frames: DataFrame, keys: list[str], time: str, tie: str, n_bins: int) -> DataFrame:
    """SMP5: ``frames`` with bin and pick_order: by bin of equal time, then by distance from its middle."""
    w = Window.partitionBy(*keys)
    spans = frames.withColumns({"_a": F.min(time).over(w), "_s": F.greatest(F.max(time).over(w) - F.min(time).over(w), F.lit(1))})
    spans = spans.withColumn("bin", F.least(F.floor((F.col(time) - F.col("_a")) * n_bins / F.col("_s")), F.lit(n_bins - 1)).cast("int"))
    away = F.abs(F.col(time) - (F.col("_a") + F.col("_s") * (F.col("bin") + 0.5) / n_bins))
    return spans.withColumn("pick_order", F.row_number().over(w.orderBy("bin", away, tie))).drop("_a", "_s")


def fill_quotas(rows: DataFrame, stratum_col: str, order: list[Column], wanted: dict[str, int]) -> DataFrame:
    """SMP8: the first rows of each stratum up to its quota, in one ranking; each task keeps only first rows of its own."""
    rank = F.row_number().over(Window.partitionBy(stratum_col).orderBy(*order))
    quota = F.lit(0)
    for name, n in wanted.items():
        quota = F.when(F.col(stratum_col) == name, n).otherwise(quota)
    return rows.withColumn("_r", rank).where(F.col("_r") <= max(wanted.values(), default=0)).where(F.col("_r") <= quota).drop("_r")


def pooled(frames: DataFrame, clips: DataFrame, skills: list[str]) -> DataFrame:
    """SMP1, SMP9: every frame with its clip's columns, its stratum, and ``excluded_by``: the first rule that keeps it out, null in the pool.

    ``frames`` has clip_id, frame_idx, t_ms, detected, trainer_contact and inverted; ``clips`` has clip_id, skill, session_date, has_video and
    trainer_present, and clips without frames come back as one row. While no clip has a skill, skills exclude nothing.
    """
    some = bool(clips.agg(F.max(F.coalesce(F.col("skill") != "", F.lit(False)))).first()[0])  # one value
    skill = F.coalesce(F.col("skill"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = clips.join(frames, "clip_id", "left")
    found = stratum(known("detected"), known("trainer_contact"), known("trainer_present"))
    rule = F.when(skill == NOT_SAMPLED, NOT_SAMPLED)
    if some:
        rule = rule.when(skill == "", "no skill").when(~skill.isin(skills), "other skill")
    rule = rule.when(F.col("frame_idx").isNull(), "no keypoints").when(~known("has_video"), "no video").when(found.isNull(), "no person")
    clip = Window.partitionBy("clip_id")
    ends = {"start_ms": F.min("t_ms").over(clip), "end_ms": F.max("t_ms").over(clip)}
    return rows.withColumns({"stratum": found, "inverted": known("inverted"), "excluded_by": rule, **ends})


def ledger(pool: DataFrame) -> DataFrame:
    """SMP9: excluded_by (``kept`` for the pool), clips and frames; frames sum to those that came in. A clip counts under each rule that took some of its frames."""
    return pool.groupBy(F.coalesce("excluded_by", F.lit("kept")).alias("excluded_by")).agg(F.countDistinct("clip_id").alias("clips"), F.count("frame_idx").alias("frames"))


def clip_order(pool: DataFrame, seed: int) -> DataFrame:
    """SMP4: clip_id and the columns that order clips: round-robin over session days, both shuffled by the seed (_turn, _day, _session)."""
    salt = F.lit(f"{seed}:")
    clips = pool.groupBy("clip_id").agg(F.min(F.coalesce("session_date", F.lit(""))).alias("_session"))
    turn = F.row_number().over(Window.partitionBy("_session").orderBy(F.md5(F.concat(salt, F.col("clip_id").cast("string")).cast("binary")), "clip_id"))
    return clips.select("clip_id", turn.alias("_turn"), F.md5(F.concat(salt, "_session").cast("binary")).alias("_day"), "_session")


def clip_picks(frames: list[tuple[int, int, str]], wanted: dict[str, int], per_clip: int, spacing: int) -> list[int]:
    """SMP6: indices of a clip's picks in order. ``frames`` are (t_ms, frame_idx, stratum) in pick order; strata take turns, each up to what is wanted of it."""
    lines = {s: [i for i, f in enumerate(frames) if f[2] == s] for s in STRATA}
    at, left, taken, times = dict.fromkeys(STRATA, 0), dict(wanted), [], []
    while len(taken) < per_clip and any(left[s] > 0 and at[s] < len(lines[s]) for s in STRATA):
        for s in STRATA:
            if len(taken) >= per_clip or left[s] <= 0 or at[s] >= len(lines[s]):
                continue
            i = lines[s][at[s]]
            at[s] += 1
            if far_enough(frames[i][0], times, spacing):
                taken.append(i)
                bisect.insort(times, frames[i][0])
                left[s] -= 1
    return taken


def far_enough(t: int, times: list[int], spacing: int) -> bool:
    """Whether t lies at least ``spacing`` from every one of the sorted times."""
    i = bisect.bisect_left(times, t)
    return (i == 0 or t - times[i - 1] >= spacing) and (i == len(times) or times[i] - t >= spacing)


def budgeted_picks(pool: DataFrame, wanted: dict[str, int], seed: int = 0, per_clip: int = PER_CLIP, spacing: int = SPACING_MS) -> DataFrame:
    """SMP4, SMP6: ``pool`` rows that are picked, with ``_turn``, ``_day``, ``_session`` (the clips' order) and ``nth`` (a clip's own order).

    Clips choose in their order, each at most ``per_clip`` frames at least ``spacing`` apart, strata in turns while their quota lasts.
    A clip's choice depends on the clips before only through the strata that are spent, so all clips choose at once as if none ran out;
    running totals find the first clip that spends one; those before it stand, that clip chooses again within what is left,
    and the clips behind it go into the next round without the spent stratum. That takes a round a stratum at most.
    """
    order = ["_turn", "_day", "_session", "clip_id"]
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    bins = pool.withColumn("bin", F.least(F.floor((F.col("t_ms") - F.col("start_ms")) * per_clip / span), F.lit(per_clip - 1)))
    bins = bins.withColumn("_away", F.abs(F.col("t_ms") - (F.col("start_ms") + span * (F.col("bin") + 0.5) / per_clip)))
    rows = settled(bins.join(clip_order(pool, seed), "clip_id"))

    def choose(rows: DataFrame, left: dict[str, int]) -> DataFrame:
        @F.arrow_udf("array<int>")
        def picked(times: pa.Array, frames: pa.Array, strata: pa.Array) -> pa.Array:
            # a clip at a time
            clips = (clip_picks(list(zip(*(c.as_py() for c in one), strict=True)), left, per_clip, spacing) for one in zip(times, frames, strata, strict=True))
            return pa.array(list(clips), pa.list_(pa.int32()))

        place = [c for k in ("bin", "_away", "frame_idx") for c in (F.col(k).isNull().alias(f"_n{k}"), F.col(k).alias(f"_k{k}"))]
        row = F.struct(*place, F.struct(*(c for c in rows.columns if c != "clip_id")).alias("row"))
        clips = rows.groupBy("clip_id").agg(F.sort_array(F.collect_list(row)).alias("_s"))
        clips = clips.withColumn("_p", picked(F.transform("_s.row.t_ms", lambda t: F.coalesce(t.cast("double"), F.lit(math.nan))), F.col("_s.row.frame_idx"), F.col("_s.row.stratum")))
        taken = clips.select("clip_id", "_s", F.posexplode("_p").alias("nth", "_i")).select("clip_id", "nth", F.get("_s", F.col("_i"))["row"].alias("_r"))
        # the id is a column of its own, so that picks can meet their pool
        return taken.select(*(F.col(c if c == "clip_id" else f"_r.{c}").alias(c) for c in rows.columns), "nth")

    left = {s: int(wanted.get(s, 0)) for s in STRATA}
    behind, out = rows, None
    while any(n > 0 for n in left.values()):
        open_strata = [s for s, n in left.items() if n > 0]
        offered = settled(choose(behind, {s: per_clip if s in open_strata else 0 for s in STRATA}))
        counts = offered.groupBy(*order).agg(*(F.count(F.when(F.col("stratum") == s, 1)).alias(f"n_{s}") for s in open_strata))
        totals = settled(running_totals(counts, order, [f"n_{s}" for s in open_strata]))
        spent = totals.where(" or ".join(f"total_n_{s} >= {left[s]}" for s in open_strata))
        edge = spent.orderBy(*order).first()
        place = F.struct(*order)
        if edge is None:
            out = offered if out is None else out.unionByName(offered)
            break
        here = F.struct(*(F.lit(edge[c]).cast(rows.schema[c].dataType).alias(c) for c in order))
        again = behind.where(F.col("clip_id") == edge["clip_id"])
        before = {s: left[s] - (edge[f"total_n_{s}"] - edge[f"n_{s}"]) if s in open_strata else 0 for s in STRATA}
        last = settled(choose(again, before))
        got = {r["stratum"]: r["n"] for r in last.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a stratum
        stand = offered.where(place < here).unionByName(last)
        out = stand if out is None else out.unionByName(stand)
        left = {s: before[s] - got.get(s, 0) for s in STRATA}
        behind = behind.where(place > here)
    out = rows.limit(0).withColumn("nth", F.lit(0)) if out is None else out
    return out.drop("bin", "_away")


def swapped_for_holds(sample: DataFrame, pool: DataFrame, share: float = INVERTED_SHARE, per_clip: int = PER_CLIP, spacing: int = SPACING_MS) -> DataFrame:
    """SMP7, SMP11: ``sample`` (of ``budgeted_picks``) with frames that are no hold replaced by holds of their stratum until the share is reached or nothing fits.

    Victims go in the order of the sample. First each clip offers its own spare holds of the victim's stratum, the nearest in time that keeps the
    spacing. What is left meets other clips below their budget, of the same session day first: such a clip offers spare holds
    that keep the spacing among themselves and to its sample, as many as its budget leaves, and the victims and the offers of a class
    (stratum and day, then stratum) are matched by rank. The sample is bounded by its quotas; of the pool only holds take part, a clip at a time.
    """
    order = ["_turn", "_day", "_session", "clip_id", "nth"]
    row = ["clip_id", "frame_idx", "t_ms", "stratum", "inverted", "session_date"]
    sample = settled(sample.select(*row, *(c for c in order if c not in row)).withColumn("pos", F.row_number().over(Window.orderBy(*order))))  # as many rows as the quotas allow
    size, held = sample.agg(F.count(F.lit(1)), F.count(F.when(F.col("inverted"), 1))).first()
    need = math.ceil(share * size - 1e-9) - held
    if need <= 0:
        return sample.select(*row)
    spare = pool.where("inverted and stratum is not null").select(*row).join(sample.select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    shape = ", ".join(f"{c} {kinds[c]}" for c in row)

    def own(taken: pd.DataFrame, spares: pd.DataFrame) -> pd.DataFrame:
        times = {r.pos: r.t_ms for r in taken.itertuples()}
        free = list(spares.sort_values(["t_ms", "frame_idx"]).itertuples(index=False))
        out = []
        for v in taken.sort_values("pos").itertuples():
            if v.inverted:
                continue
            others = sorted(t for p, t in times.items() if p != v.pos)
            fits = [f for f in free if f.stratum == v.stratum and far_enough(f.t_ms, others, spacing)]
            if fits:
                best = min(fits, key=lambda f: (abs(f.t_ms - v.t_ms), f.frame_idx))
                free.remove(best)
                times[v.pos] = best.t_ms
                out.append({**{c: getattr(best, c) for c in row}, "pos": v.pos})
        return pd.DataFrame(out, columns=[*row, "pos"])

    here = sample.groupBy("clip_id").cogroup(spare.join(sample.where("not inverted").select("clip_id").distinct(), "clip_id", "left_semi").groupBy("clip_id")).applyInPandas(own, f"{shape}, pos int")
    swaps = settled(here.orderBy("pos").limit(need))
    need -= swaps.count()
    now = _with_swaps(sample, swaps, row)
    for by in (["stratum", "session_date"], ["stratum"]):
        if need <= 0:
            break
        now = settled(now)

        def offers(taken: pd.DataFrame, spares: pd.DataFrame) -> pd.DataFrame:
            times, out = sorted(taken["t_ms"]), []
            for f in spares.sort_values(["t_ms", "frame_idx"]).itertuples(index=False):
                if len(times) >= per_clip:
                    break
                if far_enough(f.t_ms, times, spacing):
                    bisect.insort(times, f.t_ms)
                    out.append({c: getattr(f, c) for c in row})
            return pd.DataFrame(out, columns=row)

        unused = spare.join(now.select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], "left_anti")
        given = now.groupBy("clip_id").cogroup(unused.groupBy("clip_id")).applyInPandas(offers, shape)
        ranked = given.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("t_ms", "clip_id", "frame_idx"))).where(F.col("rank") <= size)
        victims = now.where("not inverted").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
        match = victims.select(*(F.coalesce(c, F.lit("")).alias(f"_{c}") for c in by), F.col("rank").alias("_rank"), "pos")
        on = [F.coalesce(F.col(c), F.lit("")) == F.col(f"_{c}") for c in by] + [F.col("rank") == F.col("_rank")]
        swaps = settled(ranked.join(match, on).select(*row, "pos").orderBy("pos").limit(need))
        need -= swaps.count()
        now = _with_swaps(now, swaps, row)
    return now.select(*row)


def _with_swaps(sample: DataFrame, swaps: DataFrame, row: list[str]) -> DataFrame:
    """``sample`` with the rows at the swaps' places replaced."""
    return sample.join(swaps.select("pos"), "pos", "left_anti").select(*row, "pos").unionByName(swaps.select(*row, "pos"))
