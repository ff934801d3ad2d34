"""Scores of holds against a reference: z, group deviations, penalty, faults and the best hold.

A scored feature is (name, SD floor, one-sided, signed). Groups are (name, weight, features).
Rows are frames with clip and hold keys, a time, ``valid`` and the features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.stats import population_sd


@dataclass(frozen=True)
class Rules:
    """What is scored, and how. The defaults are those of an inverted balance."""

    groups: tuple = (
        ("stack", 0.25, ("off_shoulder", "off_hip", "off_knee", "off_ankle", "line_deviation", "body_angle")),
        ("shoulder", 0.20, ("shoulder_angle",)),
        ("hip", 0.20, ("hip_angle", "banana")),
        ("com", 0.15, ("com_forward", "com_sway_sd")),
        ("elbows", 0.10, ("elbow_angle",)),
        ("knees_toes", 0.05, ("knee_angle", "leg_separation")),
        ("head", 0.05, ("head",)),
    )
    #: Features that are spreads of a column, by name.
    spreads: dict = field(default_factory=lambda: {"com_sway_sd": "com_forward", "hip_angle_sd": "hip_angle"})
    angles: tuple = ("body_angle", "shoulder_angle", "hip_angle", "elbow_angle", "knee_angle", "leg_separation", "head", "hip_angle_sd")
    one_sided: tuple = ("knee_angle", "elbow_angle")
    #: Features measured along the picture, turned by the frame's facing sign.
    signed: tuple = ("off_shoulder", "off_hip", "off_knee", "off_ankle", "body_angle")
    penalty: tuple = ("hip_angle_sd", 0.10)
    floor_length: float = 0.01
    floor_angle: float = 1.0
    floor_limb: float = 3.0
    cap: float = 4.0
    least_frames: int = 5
    faults: int = 3

    @property
    def features(self) -> list[str]:
        grouped = [f for _, _, members in self.groups for f in members]
        return grouped + [f for f in (self.penalty[:1] if self.penalty else ()) if f not in grouped]

    def floor(self, name: str) -> float:
        return self.floor_limb if name in self.one_sided else self.floor_angle if name in self.angles else self.floor_length


def hold_values(frames: DataFrame, keys: list[str], time: str, rules: Rules, valid: str = "valid", facing: str | None = "facing_sign", also: tuple[Column, ...] = ()) -> DataFrame:
    """SCO1: keys, extent, frames and valid frames, and a value of each feature over the valid frames; ``also`` are more aggregates."""
    use = lambda c: F.when(F.col(valid), c)
    turned = lambda f: F.col(f) * F.col(facing) if facing and f in rules.signed else F.col(f)
    values = [population_sd(use(F.col(rules.spreads[f]))).alias(f) if f in rules.spreads else F.median(use(turned(f))).alias(f) for f in rules.features]
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hold_frames"), F.count(use(F.lit(1))).alias("valid_frames"), F.min(time).alias("start"), F.max(time).alias("end"), *values, *also
    )


def reference_columns(reference: DataFrame, rules: Rules) -> dict[str, tuple[float, float]]:
    """Mean and SD by feature: one row a feature of the rules."""
    return {r["feature"]: (r["mean"], r["sd"]) for r in reference.where(F.col("feature").isin(rules.features)).collect()}


def score_holds(values: DataFrame, reference: dict[str, tuple[float, float]], rules: Rules) -> DataFrame:
    """SCO2-4, SCO6: ``values`` with z_ of every feature, dev_ of every group, deviation, penalty, score, reason and top_faults."""
    enough = F.col("valid_frames") >= rules.least_frames
    z: dict[str, Column] = {}
    for f in rules.features:
        if f in reference and reference[f][1] is not None:
            mean, sd = reference[f]
            raw = (F.col(f) - mean) / max(sd, rules.floor(f))
            raw = F.least(raw, F.lit(0.0)) if f in rules.one_sided else raw
            # least and greatest skip nulls, so an unknown value is kept unknown by hand
            z[f] = F.when(enough & F.col(f).isNotNull(), F.greatest(F.lit(-rules.cap), F.least(F.lit(rules.cap), raw)))
        else:
            z[f] = F.lit(None).cast("double")
    out = values.withColumns({f"z_{f}": c for f, c in z.items()})
    deviations, weights, total = {}, F.lit(0.0), F.lit(0.0)
    for name, weight, members in rules.groups:
        known = sum((F.col(f"z_{f}").isNotNull().cast("int") for f in members[1:]), F.col(f"z_{members[0]}").isNotNull().cast("int"))
        size = sum((F.coalesce(F.abs(f"z_{f}"), F.lit(0.0)) for f in members[1:]), F.coalesce(F.abs(F.col(f"z_{members[0]}")), F.lit(0.0)))
        deviations[f"dev_{name}"] = F.when(known > 0, size / known)
        weights = weights + F.when(known > 0, F.lit(weight)).otherwise(0.0)
        total = total + F.when(known > 0, weight * size / known).otherwise(0.0)
    penalty = F.lit(0.0)
    if rules.penalty:
        penalty = F.coalesce(rules.penalty[1] * F.greatest(F.lit(0.0), F.col(f"z_{rules.penalty[0]}")), F.lit(0.0))
    out = out.withColumns(deviations).withColumn("_w", weights)
    out = out.withColumns({"deviation": F.when(F.col("_w") > 0, total / F.col("_w")).otherwise(0.0), "penalty": penalty})
    score = F.round(100.0 * F.greatest(F.lit(0.0), 1 - (F.col("deviation") + F.col("penalty")) / rules.cap), 1)
    reason = F.when(~enough, "too few valid frames").when(F.col("_w") == 0, "nothing to compare").otherwise("")
    shares = [
        F.when(
            F.col(f"z_{f}").isNotNull(),
            F.struct((-weight * F.abs(f"z_{f}") / len(members)).alias("share"), F.lit(rules.features.index(f)).alias("rank"), F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"z_{f}").alias("z")),
        )
        for _, weight, members in rules.groups
        for f in members
    ]
    faults = F.slice(F.array_sort(F.filter(F.array(*shares), lambda s: s.isNotNull())), 1, rules.faults)
    return out.withColumns({"score": F.when(reason == "", score), "reason": reason, "top_faults": F.transform(faults, lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), s["z"].alias("z")))}).drop("_w")


def faults_text(faults: str) -> Column:
    """STR10: the faults in words, worst first."""
    return F.array_join(F.transform(faults, lambda s: F.concat(s["feature"], F.lit(" z="), F.format_number(s["z"], 2))), "; ")


def clip_hold(scores: DataFrame, clip: list[str], hold: str, start: str = "start", end: str = "end") -> DataFrame:
    """SCO5: the hold that stands for a clip: its longest scored one, the earlier on a tie."""
    w = Window.partitionBy(*clip).orderBy(F.desc(F.col(end) - F.col(start)), hold)
    return scores.where("score is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_hold(scores: DataFrame, clip: list[str], hold: str) -> DataFrame:
    """The best scored hold of each clip, the earlier on a tie."""
    w = Window.partitionBy(*clip).orderBy(F.desc("score"), hold)
    return scores.where("score is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def longest_hold(holds: DataFrame, clip: list[str], hold: str) -> DataFrame:
    """AGG5: the longest hold of each clip, the earlier on a tie."""
    w = Window.partitionBy(*clip).orderBy(F.desc(F.col("end") - F.col("start")), hold)
    return holds.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def leave_one_out(values: DataFrame, feature: str, by: list[str]) -> DataFrame:
    """SCO10: ``values`` with the mean and sample SD of the other rows of its group (two passes, from centred values)."""
    w = Window.partitionBy(*by)
    out = values.withColumn("_m", F.avg(feature).over(w)).withColumn("_d", F.col(feature) - F.col("_m"))
    n, s, q = F.count(feature).over(w), F.sum("_d").over(w), F.sum(F.col("_d") * F.col("_d")).over(w)
    mine = F.coalesce(F.col("_d"), F.lit(0.0))
    others = n - F.when(F.col(feature).isNotNull(), 1).otherwise(0)
    mean = (s - mine) / others
    square = (q - mine * mine - others * mean * mean) / (others - 1)
    return out.withColumns({"loo_mean": F.when(others > 0, F.col("_m") + mean), "loo_sd": F.when(others > 1, F.sqrt(F.greatest(square, F.lit(0.0))))}).drop("_m", "_d")


def severity(value: Column, mean: Column, sd: Column, cap: float = 4.0) -> Column:
    """SCO13: how far a value is from the reference, 0 to 1."""
    return F.least(F.lit(1.0), F.abs(value - mean) / sd / cap)


# Targets that stand in for a reference (a side and a limit in degrees or body lengths), and how far beyond one is as bad as can be.
TOLERANCES = {
    "line_deviation": ("either", 0.1),
    "body_angle": ("either", 10.0),
    "shoulder_angle": ("below", 160.0),
    "hip_angle": ("below", 165.0),
    "knee_angle": ("below", 165.0),
    "elbow_angle": ("below", 160.0),
    "banana": ("either", 0.1),
    "head": ("either", 60.0),
    "leg_separation": ("above", 30.0),
}
FAILED_FROM, BAND_DEG, BAND_LENGTH = 0.3, 20.0, 0.2
# The features that a joint, and the line over the wrists, are judged by.
JOINT_FEATURES = {
    "nose": ("head",),
    "shoulder": ("shoulder_angle", "off_shoulder"),
    "elbow": ("elbow_angle",),
    "wrist": (),
    "hip": ("hip_angle", "off_hip", "banana"),
    "knee": ("knee_angle", "off_knee"),
    "ankle": ("off_ankle", "leg_separation"),
    "foot_index": ("off_ankle", "leg_separation"),
}
STACK_FEATURES = ("line_deviation", "body_angle")
JUDGED = (*dict.fromkeys(f for members in JOINT_FEATURES.values() for f in members), *STACK_FEATURES)


def tolerance_severity(feature: str, value: Column) -> Column:
    """SCO13 without a reference: 0 within the feature's target, from 0.3 to 1 beyond it; null for what is not measured."""
    side, limit = TOLERANCES[feature]
    past = {"either": F.abs(value) - limit, "below": limit - value, "above": value - limit}[side]
    width = BAND_LENGTH if feature in ("line_deviation", "banana") else BAND_DEG
    return F.when(past > 0, F.least(F.lit(1.0), FAILED_FROM + past / width)).when(value.isNotNull(), 0.0)


def band(severity: Column) -> Column:
    """SCO16."""
    return F.when(severity < 0.25, "ok").when(severity < 0.5, "warn").when(severity.isNotNull(), "bad")


def heat_strip(frames: DataFrame, keys: list[str], time: str, value: str, bins: int) -> DataFrame:
    """SCO18: keys, bin and the greatest value in it, for every bin of the series' time."""
    ends = frames.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = F.least(F.floor((F.col(time) - F.col("_a")) * bins / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9))), F.lit(bins - 1)).cast("int")
    got = frames.join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.max(value).alias("peak"))
    return every.join(got, [*keys, "bin"], "left")


def worst_moment(frames: DataFrame, keys: list[str], hold: str, time: str, value: str, edge: float, least: float = 0.5) -> DataFrame:
    """SCO19: the row of greatest value of each key, off the edges of its hold, the earlier on a tie."""
    w = Window.partitionBy(*keys, hold)
    inside = frames.withColumns({"_a": F.min(time).over(w), "_b": F.max(time).over(w)}).where((F.col(time) >= F.col("_a") + edge) & (F.col(time) <= F.col("_b") - edge))
    ranked = inside.where(F.col(value) >= least).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), time)))
    return ranked.where("_r = 1").drop("_a", "_b", "_r")


def window_cut(frames: DataFrame, hold: str, wanted: int | Column, time: str, start: Column, end: Column) -> DataFrame:
    """SHP3: hold ids outside the window, or of other holds, become -1."""
    inside = (F.col(hold) == wanted) & F.col(time).between(start, end)
    return frames.withColumn(hold, F.when(F.coalesce(inside, F.lit(False)), F.col(hold)).otherwise(-1))


def frame_severities(features: DataFrame, reference: dict[str, tuple[float, float]] | None, rules: Rules, facing: str = "facing_sign") -> DataFrame:
    """SCO14, SCO15: ``features`` with severities (map by feature), severity (their greatest) and its band.

    Only frames of a hold that are valid are measured, by the features of a joint or of the line over the wrists (``JUDGED``). Values along the
    picture are turned first. Without a reference the targets of ``TOLERANCES`` judge, whatever the facing.
    """
    pairs = [F.struct(F.lit(f).alias("key"), size.alias("value")) for f, size in severities(reference, rules, facing).items()]
    if not pairs:
        pairs = [F.struct(F.lit("").alias("key"), F.lit(None).cast("double").alias("value"))]
    measured = F.coalesce((F.col("hold_id") >= 0) & F.col("valid"), F.lit(False))
    known = F.filter(F.array(*pairs), lambda p: measured & p["value"].isNotNull())
    out = features.withColumn("severities", F.map_from_entries(known))
    return out.withColumn("severity", F.array_max(F.map_values("severities"))).withColumn("band", band(F.col("severity")))


def severities(reference: dict[str, tuple[float, float]] | None, rules: Rules, facing: str = "facing_sign") -> dict[str, Column]:
    """SCO13: the severity of a frame by each of the features (``JUDGED``) that can be judged."""
    sizes = {}
    for f in JUDGED:
        if reference is None:
            size = tolerance_severity(f, F.col(f)) if f in TOLERANCES else None
        elif f in reference:
            mean, sd = reference[f]
            value = F.col(f) * F.col(facing) if f in rules.signed else F.col(f)
            size = severity(value, F.lit(mean), F.lit(max(sd, rules.floor(f))), rules.cap)
        else:
            size = None
        if size is not None:
            sizes[f] = size.cast("double")
    return sizes


def reviewed_values(holds: DataFrame, features: DataFrame, rules: Rules) -> DataFrame:
    """SCO8: a row for every distinct reviewed hold (clip_id, hold_id) with its values, and ``note``: why it is skipped, null where it is not.

    ``features`` has a row a frame. A hold is skipped when its clip has no features, when the clip has no frame of it, or when too few are valid.
    """
    wanted = holds.select("clip_id", F.col("hold_id").cast("long").alias("hold_id")).distinct()
    known = features.select("clip_id").distinct().withColumn("_clip", F.lit(True))
    frames = features.withColumn("hold_id", F.col("hold_id").cast("long")).join(wanted, ["clip_id", "hold_id"], "left_semi")
    values = hold_values(frames, ["clip_id", "hold_id"], "t_ms", rules)
    out = wanted.join(known, "clip_id", "left").join(values, ["clip_id", "hold_id"], "left")
    note = F.when(F.col("_clip").isNull(), "features file missing").when(F.col("hold_frames").isNull(), "hold id not in features").when(F.col("valid_frames") < rules.least_frames, "too few valid frames")
    return out.select("clip_id", "hold_id", *(F.when(note.isNull(), F.col(f)).alias(f) for f in rules.features), note.alias("note"))


# What is said of a fault, the least deviation worth a sentence, and the share of a hold out of balance.
CUE_TEXTS = {
    "shoulder_angle": "Open your shoulders: push the floor away, arms by your ears.",
    "hip_angle": "Hips are piked: squeeze your glutes and bring your legs in line.",
    "knee_angle": "Straighten your knees and point your toes.",
    "elbow_angle": "Lock your elbows.",
    "banana_pos": "You're arching (banana): pull your ribs in and tuck the pelvis.",
    "banana_neg": "You're hollowing at the hips: open the hips to a straight line.",
    "head": "Keep your head neutral: eyes on the floor between your hands.",
    "leg_separation": "Keep your legs together.",
    "line_deviation": "Your line leans: stack hips over shoulders over hands.",
    "body_angle": "Your line leans: stack hips over shoulders over hands.",
    "off_shoulder": "Stack your shoulders over your hands.",
    "off_hip": "Stack your hips over your hands.",
    "off_knee": "Stack your knees over your hands.",
    "off_ankle": "Stack your ankles over your hands.",
    "balance_over": "You're tipping towards your fingers: press into your fingertips.",
    "balance_under": "You're sitting back on your palms: shift a little over your fingers.",
    "none": "Solid line: nothing over the limits in this hold.",
}
CUE_Z, CUE_BALANCE, CUE_BALANCE_SEVERITY = 1.5, 30.0, 0.4


def _cue(feature: Column, value: Column) -> Column:
    """The key of a fault's text: a bend has one for each direction, and none without a direction."""
    return F.when(feature != "banana", feature).when(value > 0, "banana_pos").when(value < 0, "banana_neg")


def session_cues(scores: DataFrame, summary: DataFrame, most: int = 3, cap: float = 4.0, tolerances: list[tuple[str, Column, Column]] | None = None) -> DataFrame:
    """SCO20: clip_id, rank, cue, severity and text of the longest hold of each clip, the severest first: ``none`` where nothing is wrong.

    ``scores`` has the holds' top_faults, ``summary`` their extent, medians and balance. Without a reference ``tolerances`` stands for the scores: (feature,
    whether its median fails, its severity) as columns of the summary. Equal severities keep the order faults, over, under.
    """
    w = Window.partitionBy("clip_id").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "hold_id")
    longest = summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    entry = lambda key, size: F.struct(key.alias("cue"), size.alias("severity"))
    if tolerances is None:
        rows = longest.join(scores.select("clip_id", "hold_id", "top_faults"), ["clip_id", "hold_id"], "left")
        far = F.filter(F.coalesce("top_faults", F.array().cast(scores.schema["top_faults"].dataType)), lambda f: F.abs(f["z"]) >= CUE_Z)
        faults = F.transform(far, lambda f: entry(_cue(f["feature"], f["value"]), F.least(F.abs(f["z"]), F.lit(cap)) / cap))
    else:
        rows = longest
        faults = F.array(*(entry(F.when(F.coalesce(fails, F.lit(False)), _cue(F.lit(name), F.col(f"{name}_median"))), size.cast("double")) for name, fails, size in tolerances))
    balance = [entry(F.when(F.col(f"pct_{k}") > CUE_BALANCE, F.lit(f"balance_{k}")), F.lit(CUE_BALANCE_SEVERITY)) for k in ("over", "under")]
    texts = F.create_map(*(F.lit(x) for pair in CUE_TEXTS.items() for x in pair))
    said = F.filter(F.concat(faults, F.array(*balance)), lambda c: c["cue"].isNotNull() & F.array_contains(F.map_keys(texts), c["cue"]))
    placed = F.transform(said, lambda c, i: F.struct((-c["severity"]).alias("s"), i.alias("i"), c["cue"].alias("cue")))
    none = F.array(F.struct(F.lit(-0.0).alias("s"), F.lit(0).alias("i"), F.lit("none").alias("cue")))
    ranked = F.when(F.size(said) == 0, none).otherwise(F.slice(F.array_sort(placed), 1, most))
    out = rows.select("clip_id", F.posexplode(ranked).alias("p", "c"))
    return out.select("clip_id", (F.col("p") + 1).alias("rank"), F.col("c.cue").alias("cue"), F.abs("c.s").alias("severity"), texts[F.col("c.cue")].alias("text"))
