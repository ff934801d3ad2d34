"""Comparing pose models with human labels: errors, swaps, matching, disagreement and review order.

Labels and poses are long rows: frame keys, joint, x, y and, for poses, a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import stats

SHARED_JOINTS = 4
SWAP_SEPARATION, SWAP_MARGIN, SWAP_STRONG = 0.15, 0.05, 0.5


def joint_errors(labels: DataFrame, poses: DataFrame, keys: list[str], length: str) -> DataFrame:
    """BAK7: a row a labelled joint: score, has_pred and error in body lengths; joints that are not labelled are in no denominator."""
    pred = poses.select(*keys, "joint", F.col("x").alias("p_x"), F.col("y").alias("p_y"), "score")
    both = labels.join(pred, [*keys, "joint"], "left")
    there = F.col("p_x").isNotNull() & F.col("p_y").isNotNull()
    error = F.when(there & (F.col(length) > 0), F.hypot(F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")) / F.col(length))
    return both.withColumns({"has_pred": there, "error": error}).drop("p_x", "p_y")


def metrics(errors: DataFrame, groupings: list[list[str]], gate: float, levels: tuple[float, ...] = (0.2, 0.5), clip: str = "clip_id", frame: str = "frame_idx") -> DataFrame:
    """BAK8-10, BAK16: shares within the levels, misses, mean and median error, frames and clips, for all groupings in one pass."""
    names = list(dict.fromkeys(c for g in groupings for c in g))
    delivered = F.when(F.col("has_pred") & (F.col("score") >= gate), F.col("error"))
    shares = [F.avg(F.coalesce((delivered <= v), F.lit(False)).cast("double")).alias(f"pck{str(v).replace('.', '')}") for v in levels]
    return errors.groupingSets(groupings, *names).agg(
        *shares,
        F.avg(delivered.isNull().cast("double")).alias("miss_rate"),
        F.avg(delivered).alias("mean_error"),
        F.median(delivered).alias("median_error"),
        F.countDistinct(clip, frame).alias("n_frames"),
        F.countDistinct(clip).alias("n_clips"),
    )


def swapped(gl: Column, gr: Column, pl: Column, pr: Column, left_score: Column, right_score: Column, length: Column, gate: float) -> Column:
    """BAK11: whether a pose has a pair's sides exchanged; null where labels are too close or a joint is not delivered."""
    d = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    direct, cross = d(pl, gl) + d(pr, gr), d(pl, gr) + d(pr, gl)
    judged = (d(gl, gr) >= SWAP_SEPARATION * length) & (left_score >= gate) & (right_score >= gate)
    return F.when(judged, ((direct - cross) > SWAP_STRONG * (direct + cross)) & ((direct - cross) > SWAP_MARGIN * length))


def best_person(labels: DataFrame, pool: DataFrame, keys: list[str], person: str, least: int = SHARED_JOINTS) -> DataFrame:
    """BAK6: the person of each frame nearest to the labels on average over enough shared joints; the first on a tie."""
    p = pool.select(*keys, person, "joint", F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    near = labels.join(p, [*keys, "joint"]).where("p_x is not null and p_y is not null")
    wanted = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    means = near.groupBy(*keys, person).agg(F.avg(F.hypot(F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y"))).alias("error"), F.count(F.lit(1)).alias("shared"))
    enough = means.join(wanted, keys).where(F.col("shared") >= F.least(F.lit(least), F.col("_n")))
    w = Window.partitionBy(*keys).orderBy("error", person)
    return enough.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def keypoint_gap(first: DataFrame, second: DataFrame, keys: list[str], length: str, least: int = SHARED_JOINTS) -> DataFrame:
    """BAK18: keys and gap, the median distance of shared joints in body lengths; null under enough of them."""
    b = second.select(*keys, "joint", F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    d = F.hypot(F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")) / F.when(F.col(length) > 0, F.col(length))
    return first.join(b, [*keys, "joint"]).groupBy(*keys).agg(F.when(F.count(d) >= least, F.median(d)).alias("gap"))


def disagreement(points: DataFrame, keys: list[str], model: str, length: str) -> DataFrame:
    """BAK20: keys, the largest distance between two models' views of a joint in body lengths, and that joint.

    Frames have a few models, so the pairs of a joint are few.
    """
    a = points.where("x is not null and y is not null")
    b = a.select(*keys, "joint", F.col(model).alias("_m"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    pairs = a.join(b, [*keys, "joint"]).where(F.col(model) < F.col("_m"))
    far = pairs.groupBy(*keys, "joint").agg(F.max(F.hypot(F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")) / F.col(length)).alias("d"))
    w = Window.partitionBy(*keys).orderBy(F.desc("d"), "joint")
    return far.withColumn("_r", F.row_number().over(w)).where("_r = 1 and d > 0").select(*keys, F.col("d").alias("max_disagreement"), "joint")


def review_order(rows: DataFrame, low_joints: str, disagreement: str, image: str, n_joints: int = 15, weight: float = 0.5) -> DataFrame:
    """BAK21: ``rows`` in order of review: without a pre-label first, then the most doubtful, then by name."""
    low = F.size(low_joints)
    doubt = F.coalesce(disagreement, F.lit(0.0)) + weight * low / n_joints
    return rows.orderBy(F.when(low >= n_joints, 0).otherwise(1), F.desc(doubt), image)


def choose_orientation(upright: Column, rotated: Column) -> Column:
    """BAK24: whether the turned reading is the more confident; upright on a tie."""
    return F.coalesce(rotated > upright, F.lit(False))


def unusable_clips(frames: DataFrame, spans: list[str], score: str, gates: list[float], least_rows: int = 10, q: float = 0.9, least: float = 1.0) -> DataFrame:
    """BAK14: gate and the clips that have no body length at it, all gates in one pass over the frames."""
    gated = lambda s, g: F.when(F.col(score) >= g, F.col(s))
    columns = [c for i, g in enumerate(gates) for j, s in enumerate(spans) for c in (F.count(gated(s, g)).alias(f"n_{i}_{j}"), stats.quantile(gated(s, g), q).alias(f"q_{i}_{j}"))]
    clips = frames.groupBy("clip_id").agg(*columns)
    few = lambda i: F.least(*(F.col(f"n_{i}_{j}") for j in range(len(spans))), F.lit(1 << 62)) < least_rows
    short = lambda i: sum((F.col(f"q_{i}_{j}") for j in range(1, len(spans))), F.col(f"q_{i}_0")) < least
    counts = clips.agg(*(F.count_if(few(i) | F.coalesce(short(i), F.lit(True))).alias(f"u_{i}") for i in range(len(gates))))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(f"u_{i}").alias("unusable")) for i, g in enumerate(gates)))))


# The least share within reach that needs no further training.
TRAIN_BELOW = 0.6
HEADLINE = ("rate", "low", "high")


def decision(headline: DataFrame, groups: DataFrame, first: str, preferred: str, bound: str) -> DataFrame:
    """BAK17: one row of figures by which a model is chosen: the preferred one wherever the intervals of the two meet, else the one of higher rate.

    ``headline`` has a row for each model and setting (``recommended``, ``common``) with rate, low and high; ``groups`` model, group and rate of the groups
    that decide about training. ``bound`` is the model that tells how much could be gained; it takes no part in the choice. ``choice`` is null where a rate
    is missing, and ``robust`` (same winner, meeting intervals or another winner at the common gate) where either has no row there.
    The lower rate of a tie goes to ``first``. Both inputs are folded in one aggregation each; a model that repeats counts by its greatest values.
    """
    at = lambda m, s: (F.col("model") == m) & (F.col("setting") == s)
    finite = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    wanted = [(k, m, s) for s in ("recommended", "common") for k, m in (("first", first), ("preferred", preferred), ("bound", bound)) if (k, s) != ("bound", "common")]
    figures = headline.agg(*(F.max(F.when(at(m, s), finite(c))).alias(f"{k}_{s}_{c}") for k, m, s in wanted for c in HEADLINE), *(F.count_if(at(m, s)).alias(f"_{k}_{s}") for k, m, s in wanted))
    v = lambda k, s, c="rate": F.col(f"{k}_{s}_{c}")
    apart = lambda s: F.coalesce((v("first", s, "high") < v("preferred", s, "low")) | (v("preferred", s, "high") < v("first", s, "low")), F.lit(False))
    known = v("first", "recommended").isNotNull() & v("preferred", "recommended").isNotNull()
    meet = v("first", "recommended", "low").isNotNull() & v("preferred", "recommended", "low").isNotNull() & ~apart("recommended")
    ahead = lambda s: v("preferred", s) > v("first", s)
    same = ahead("common").eqNullSafe(ahead("recommended"))
    out = figures.withColumns(
        {
            "overlap": meet,
            "choice": F.when(known, F.when(meet | ahead("recommended"), preferred).otherwise(first)),
            "decisive": known & ~meet,
            "robust": F.when((F.col("_first_common") > 0) & (F.col("_preferred_common") > 0), F.when(~same, "differs").when(apart("common"), "same").otherwise("same, intervals meet")),
            "headroom": v("bound", "recommended") - F.coalesce(F.greatest(v("first", "recommended"), v("preferred", "recommended")), F.lit(0.0)),
        }
    )
    worst = groups.agg(*(F.min(F.when(F.col("model") == m, finite("rate"))).alias(f"{k}_worst") for k, m in (("first", first), ("preferred", preferred))))
    low = [F.coalesce(F.col(f"{k}_worst") < TRAIN_BELOW, F.lit(False)) for k in ("first", "preferred")]
    # one row by one row
    return out.drop(*(f"_{k}_{s}" for k, _, s in wanted)).crossJoin(worst.withColumn("train", low[0] & low[1]))
