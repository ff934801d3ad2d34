"""Seeded clips of a figure that goes up into a balance and comes down: a source of keypoints without any video.

A clip is one of five stories (``CASES``), drawn as keyframes of a chain of rigid segments, with sway in the holds,
seeded jitter and a detector's failures. Every number follows from (seed, clip, frame, joint) alone:
the jitter is a normal deviate made of that key's MD5, so any partition makes its rows anywhere and alike.

``clips`` draws them for the rows of a table, as columns; ``ClipSource`` is the same as a data
source: ``spark.dataSource.register(ClipSource)``, then ``spark.read.format("pose_clips").option("clips", 1000).load()``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The figure in pixels (upper body 105, thigh 100, shin 95: 300 a body length), its joints and how well they are seen.
TORSO, THIGH, SHIN, ARM, HEAD, NOSE, ELBOW, TOE = 105.0, 100.0, 95.0, 100.0, 45.0, 25.0, 0.45, 14.0
HIP = (288.0, 695.0)
OFFSETS = {"shoulder": 4.0, "elbow": 5.5, "wrist": 7.0, "hip": 3.0, "knee": 6.0, "ankle": 8.0, "foot_index": 8.0}
SEEN = {"nose": 0.9, "left": 0.95, "right": 0.72}
SWAY_DEG, SWAY_PERIOD_S, SWAY_RAMP_S = 2.0, 1.7, 0.3
STEP_PX, STEP_S = 45.0, 0.15
CYCLE_MS = (33, 36, 31, 34, 30, 37, 33, 32)
LOW_VISIBILITY, DIGITS = 0.1, 6
#: Clips of a partition: half a million samples.
CLIPS_A_PART = 250
#: Jitter in pixels where a story asks for none of its own.
JITTER_PX = 0.3
JOINTS = ("nose", *(f"{side}_{part}" for part in OFFSETS for side in ("left", "right")))


@dataclass(frozen=True)
class Pose:
    """The hip's place and the directions of the chain in degrees (0 right, 90 down), not wrapped."""

    hip_x: float
    hip_y: float
    trunk: float
    leg: float
    arm: float
    foot: float
    step: float = 0.0


STAND = Pose(*HIP, 270.0, 90.0, 90.0, 15.0)
PLANTED = Pose(*HIP, 450.0, 90.0, 90.0, 15.0)
UP = Pose(*HIP, 450.0, 270.0, 90.0, -90.0)
ARCHED = Pose(HIP[0] + 45.0, 705.1, 475.4, 265.6, 90.0, -90.0)
STEPPED = replace(UP, step=STEP_PX)


@dataclass(frozen=True)
class Mutation:
    """What happens to ``count`` frames from the first at or after ``at_s``: low_visibility, undetected, contact or outlier (one joint, by ``delta`` pixels)."""

    kind: str
    at_s: float
    count: int = 1
    joint: str = ""
    delta: float = 0.0


@dataclass(frozen=True)
class Story:
    """Keyframes (seconds, pose, whether the stretch that ends here sways), failures and jitter."""

    keys: tuple[tuple[float, Pose, bool], ...]
    mutations: tuple[Mutation, ...] = ()
    jitter: float = JITTER_PX

    @property
    def held_from(self) -> float:
        """When the first swaying stretch begins."""
        first = next(i for i, k in enumerate(self.keys) if k[2])
        return self.keys[first - 1][0]

    @property
    def sways(self) -> list[tuple[float, float]]:
        return [(a[0], b[0]) for a, b in zip(self.keys, self.keys[1:], strict=False) if b[2]]

    def times(self, nth: int) -> list[int]:
        """Frame times in milliseconds before the end; the cycle of gaps begins at another place for each story."""
        end, out = round(self.keys[-1][0] * 1000), [0]
        while out[-1] < end:
            out.append(out[-1] + CYCLE_MS[(nth + len(out) - 1) % len(CYCLE_MS)])
        return out[:-1]


def _story(up: Pose, held_s: float, second_s: float | None = None) -> tuple[tuple[float, Pose, bool], ...]:
    """Stand, plant, wait, kick up, hold (twice, with a step of one hand between), come down, stand."""
    moves = [(0.0, STAND, False), (0.40, STAND, False), (0.30, PLANTED, False), (0.25, PLANTED, False), (0.45, up, False), (held_s, up, True)]
    if second_s is not None:
        moves += [(STEP_S, STEPPED, False), (second_s, STEPPED, True)]
    moves += [(0.45, PLANTED, False), (0.45, STAND, False), (0.40, STAND, False)]
    clock = accumulate(m[0] for m in moves)
    return tuple((round(t, 6), pose, sway) for t, (_, pose, sway) in zip(clock, moves, strict=True))


def _cases() -> dict[str, Story]:
    rough = Story(_story(UP, 2.40), jitter=1.5)
    at = rough.held_from
    failures = (Mutation("low_visibility", at + 0.70, 4), Mutation("outlier", at + 1.20, 1, "left_ankle", 180.0), Mutation("undetected", at + 1.75, 7))
    return {
        "line_hold": Story(_story(UP, 3.35)),
        "banana_hold": Story(_story(ARCHED, 2.20)),
        "hand_step": Story(_story(UP, 1.05, 1.30)),
        "gaps_and_noise": replace(rough, mutations=failures),
        "trainer_contact": Story(_story(UP, 2.40), (Mutation("contact", at + 1.10, 7),)),
    }


CASES = _cases()
NAMES = tuple(CASES)
FIELDS = ("hip_x", "hip_y", "trunk", "leg", "arm", "foot", "step")
SCHEMA = "clip_id long, case string, frame_idx long, t_ms long, joint string, x double, y double, visibility double, trainer_contact boolean"


def failing(story: Story, nth: int) -> list[tuple[str, int, int, str, float]]:
    """(kind, first frame, frame after the last, joint, delta) of a story's failures."""
    times = story.times(nth)
    out = []
    for m in story.mutations:
        first = min(int(np.searchsorted(times, round(m.at_s * 1000))), len(times) - 1)
        out.append((m.kind, first, min(first + (1 if m.kind == "outlier" else m.count), len(times)), m.joint, m.delta))
    return out


def _case_rows() -> list[tuple]:
    rows = []
    for i, (name, story) in enumerate(CASES.items()):
        moves = [(a[0], b[0], *((getattr(a[1], f), getattr(b[1], f)) for f in FIELDS)) for a, b in zip(story.keys, story.keys[1:], strict=False)]
        rows.append((name, story.jitter, story.times(i), moves, story.sways, failing(story, i)))
    return rows


_PAIR = "struct<a: double, b: double>"
_CASE_SCHEMA = (
    f"case string, jitter double, times array<int>, moves array<struct<t0: double, t1: double, {', '.join(f'{f}: {_PAIR}' for f in FIELDS)}>>, "
    "sways array<struct<a: double, b: double>>, failing array<struct<kind: string, first: int, after: int, joint: string, delta: double>>"
)


def _smooth(x: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return x * x * (3.0 - 2.0 * x)


def frames(spark: SparkSession) -> DataFrame:
    """A row for each frame of each story: case, frame_idx, t_ms, the pose's fields, ``sway`` in degrees, jitter and ``failing``."""
    cases = spark.createDataFrame(_case_rows(), _CASE_SCHEMA)
    rows = cases.select("*", F.posexplode("times").alias("frame_idx", "t_ms")).drop("times")
    t = F.col("t_ms") / 1000.0
    rows = rows.withColumn("_m", F.get(F.filter("moves", lambda m: (m["t0"] <= t) & (t < m["t1"])), 0))
    eased = _smooth((t - F.col("_m.t0")) / (F.col("_m.t1") - F.col("_m.t0")))
    rows = rows.withColumn("_e", eased)
    pose = {f: F.col(f"_m.{f}.a") + (F.col(f"_m.{f}.b") - F.col(f"_m.{f}.a")) * F.col("_e") for f in FIELDS}
    share = F.aggregate("sways", F.lit(0.0), lambda s, r: F.greatest(s, F.when((t >= r["a"]) & (t <= r["b"]), _smooth((t - r["a"]) / SWAY_RAMP_S) * _smooth((r["b"] - t) / SWAY_RAMP_S)).otherwise(0.0)))
    sway = SWAY_DEG * F.sin(2.0 * np.pi * t / SWAY_PERIOD_S) * share
    return rows.withColumns({**pose, "sway": sway}).drop("_m", "_e", "moves", "sways")


def _figure() -> dict[str, tuple[Column, Column]]:
    """The joints' places before the sway."""

    def away(p: tuple[Column, Column], degrees: Column, length: float) -> tuple[Column, Column]:
        turn = F.radians(degrees)
        return p[0] + F.cos(turn) * length, p[1] + F.sin(turn) * length

    hip = F.col("hip_x"), F.col("hip_y")
    shoulder = away(hip, F.col("trunk"), TORSO)
    ankle = away(hip, F.col("leg"), THIGH + SHIN)
    wrist = away(shoulder, F.col("arm"), ARM)
    middle = {
        "shoulder": shoulder,
        "elbow": tuple(s + ELBOW * (w - s) for s, w in zip(shoulder, wrist, strict=True)),
        "wrist": wrist,
        "hip": hip,
        "knee": away(hip, F.col("leg"), THIGH),
        "ankle": ankle,
        "foot_index": away(ankle, F.col("foot"), TOE),
    }
    nose = away(shoulder, F.col("trunk"), HEAD)
    points = {"nose": (nose[0] + NOSE, nose[1])}
    for part, (x, y) in middle.items():
        points[f"left_{part}"] = (x - OFFSETS[part] + (F.col("step") if part == "wrist" else 0.0), y)
        points[f"right_{part}"] = (x + OFFSETS[part], y)
    return points


def with_deviates(df: DataFrame, one: str, two: str, *key: Column) -> DataFrame:
    """``df`` with two independent standard normal deviates of a key.

    The digest, its size and its turn are columns of their own: in one expression each use would work the digest out again.
    """
    # sixteen digits as one signed number: the first eight are its upper half
    df = df.withColumn("_both", F.conv(F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, 16), 16, -10).cast("long"))
    first, second = ((n.cast("double") + 0.5) / 4294967296.0 for n in (F.shiftrightunsigned("_both", 32), F.col("_both").bitwiseAND(F.lit(0xFFFFFFFF))))
    df = df.withColumns({"_far": F.sqrt(-2.0 * F.log(first)), "_turn": 2.0 * np.pi * second}).drop("_both")
    return df.withColumns({one: F.col("_far") * F.cos("_turn"), two: F.col("_far") * F.sin("_turn")}).drop("_far", "_turn")


def to_digits(x: Column) -> Column:
    """x to ``DIGITS`` places, a half upwards, in doubles (``round`` takes every number through a decimal)."""
    return F.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def clips(seeds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ORC6: keypoints (``SCHEMA``) of ``seeds`` (clip_id, case, seed, size: pixels of a pixel of the figure). ``keep`` are columns of the seeds to carry along."""
    points = _figure()
    drawn = frames(seeds.sparkSession).select(
        "case", "jitter", "failing", "frame_idx", "t_ms", "sway",
        F.array(*(F.struct(F.lit(j).alias("joint"), x.alias("x"), y.alias("y")) for j, (x, y) in points.items())).alias("body"),
    )
    at = {j: i for i, j in enumerate(points)}
    wrists = [F.element_at("body", at[f"{s}_wrist"] + 1) for s in ("left", "right")]
    drawn = drawn.withColumns({"_ox": (wrists[0]["x"] + wrists[1]["x"]) / 2, "_oy": (wrists[0]["y"] + wrists[1]["y"]) / 2})
    # outer: of a plain explode Spark infers a filter that repeats the body's expressions, and works on it for seconds
    rows = drawn.select("*", F.explode_outer("body").alias("p")).select("*", "p.*").drop("p", "body")
    cos, sin = F.cos(F.radians("sway")), F.sin(F.radians("sway"))
    dx, dy = F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")
    hit = lambda kind: F.filter("failing", lambda m: (m["kind"] == kind) & (F.col("frame_idx") >= m["first"]) & (F.col("frame_idx") < m["after"]))
    seen = F.when(F.col("joint") == "nose", SEEN["nose"]).when(F.col("joint").startswith("left"), SEEN["left"]).otherwise(SEEN["right"])
    rows = rows.select(
        "case", "jitter", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("t_ms").cast("long").alias("t_ms"), "joint", (F.col("_ox") + cos * dx - sin * dy).alias("x"), (F.col("_oy") + sin * dx + cos * dy).alias("y"),
        F.coalesce(F.get(F.filter(hit("outlier"), lambda m: m["joint"] == F.col("joint")), 0)["delta"], F.lit(0.0)).alias("spike"), (F.size(hit("undetected")) > 0).alias("gone"),
        F.when(F.size(hit("low_visibility")) > 0, LOW_VISIBILITY).otherwise(seen).alias("visibility"), (F.size(hit("contact")) > 0).alias("trainer_contact"),
    )
    # the stories' samples: some twelve thousand rows whatever the number of clips
    rows = dealt(seeds).join(F.broadcast(rows), "case")
    rows = with_deviates(rows, "_gx", "_gy", F.col("seed"), F.col("clip_id"), F.col("frame_idx"), F.col("joint"))
    rows = rows.withColumns({c: F.col("size") * (F.col(c) + F.col("jitter") * F.col(f"_g{c}")) for c in ("x", "y")})
    return rows.select(
        "clip_id", "case", "frame_idx", "t_ms", "joint", F.when(~F.col("gone"), to_digits(F.col("x") + F.col("spike") * F.col("size"))).alias("x"),
        F.when(~F.col("gone"), to_digits(F.col("y"))).alias("y"), F.when(~F.col("gone"), F.col("visibility")).alias("visibility"), "trainer_contact", *keep,
    )


def dealt(seeds: DataFrame) -> DataFrame:
    """``seeds`` by clip_id over partitions of at most some ``CLIPS_A_PART`` clips: a short table lies in one file, and what is drawn from it stays where its clip is."""
    n, cores = seeds.count(), seeds.sparkSession.sparkContext.defaultParallelism
    return seeds.repartition(max(1, -(-n // CLIPS_A_PART), min(2 * cores, n // 10)), "clip_id")


# The stories of an orientation chooser and how surely a reading right or wrong, or mistaken with certainty, is scored.
ORIENTATION_STORIES = ("steady_upright", "steady_inverted", "one_frame_misread", "sustained_switch", "nan_gaps", "vfr_timestamps")
RIGHT, WRONG, SURE = 0.9, 0.6, 0.99
STEP_MS, SCORE_NOISE = 100, 0.004


def uneven_ms(n: int) -> int:
    """The gap after the n-th frame of a clip whose frame rate varies: 60 to 160."""
    return 60 + 37 * n % 101


def orientation_story(name: str) -> list[tuple[int, int, float | None, float | None]]:
    """Frames (index, t_ms, upright score, rotated score) of a story without noise."""
    many = 70 if name == "nan_gaps" else 40
    gaps = (uneven_ms(n) if name == "vfr_timestamps" else STEP_MS for n in range(many - 1))
    turned = {"sustained_switch": 10, "vfr_timestamps": 15}.get(name, many)
    rows = []
    for n, t in enumerate(accumulate(gaps, initial=0)):
        upright, rotated = (RIGHT, WRONG) if n < turned else (RIGHT, SURE)
        if name in ("steady_inverted", "nan_gaps"):
            upright, rotated = WRONG, RIGHT
        if name == "one_frame_misread" and n == 12:
            rotated = SURE
        if name == "nan_gaps" and n >= 50:
            upright, rotated = SURE, WRONG
        if name == "nan_gaps" and (20 <= n < 24 or 40 <= n < 50):
            upright = rotated = None
        rows.append((n, t, upright, rotated))
    return rows


def orientation_clips(seeds: DataFrame, noise: float = SCORE_NOISE) -> DataFrame:
    """ORC9: clip_id, case, frame_idx, t_ms, score_upright, score_rotated of ``seeds`` (clip_id, case, seed); a frame where nobody was found has no scores."""
    rows = [(name, *r) for name in ORIENTATION_STORIES for r in orientation_story(name)]
    # 270 rows whatever the number of clips
    frames = F.broadcast(seeds.sparkSession.createDataFrame(rows, "case string, frame_idx long, t_ms long, upright double, rotated double"))
    rows = with_deviates(seeds.join(frames, "case"), "_one", "_two", F.col("seed"), F.col("clip_id"), F.col("frame_idx"), F.lit("score"))
    scores = {"score_upright": F.round(F.col("upright") + noise * F.col("_one"), DIGITS), "score_rotated": F.round(F.col("rotated") + noise * F.col("_two"), DIGITS)}
    return rows.withColumns(scores).select("clip_id", "case", "frame_idx", "t_ms", *scores)


def drawn_clip(clip_id: int, seed: int, size: float = 1.0) -> dict[str, np.ndarray]:
    """One clip's columns as arrays, frame by frame and joint by joint; the story follows from the id."""
    nth = clip_id % len(NAMES)
    story = CASES[NAMES[nth]]
    t_ms = np.array(story.times(nth))
    t = t_ms / 1000.0
    ease = lambda x: np.clip(x, 0, 1) ** 2 * (3 - 2 * np.clip(x, 0, 1))
    starts = np.array([k[0] for k in story.keys])
    i = np.searchsorted(starts, t, "right") - 1
    e = ease((t - starts[i]) / (starts[i + 1] - starts[i]))
    field = {f: np.array([getattr(k[1], f) for k in story.keys]) for f in FIELDS}
    pose = {f: v[i] + (v[i + 1] - v[i]) * e for f, v in field.items()}
    share = np.max([np.where((t >= a) & (t <= b), ease((t - a) / SWAY_RAMP_S) * ease((b - t) / SWAY_RAMP_S), 0) for a, b in story.sways], axis=0)
    sway = np.radians(SWAY_DEG * np.sin(2 * np.pi * t / SWAY_PERIOD_S) * share)
    away = lambda p, degrees, length: (p[0] + np.cos(np.radians(degrees)) * length, p[1] + np.sin(np.radians(degrees)) * length)
    hip = pose["hip_x"], pose["hip_y"]
    shoulder, ankle = away(hip, pose["trunk"], TORSO), away(hip, pose["leg"], THIGH + SHIN)
    wrist = away(shoulder, pose["arm"], ARM)
    elbow = tuple(s + ELBOW * (w - s) for s, w in zip(shoulder, wrist, strict=True))
    middle = dict(zip(OFFSETS, (shoulder, elbow, wrist, hip, away(hip, pose["leg"], THIGH), ankle, away(ankle, pose["foot"], TOE)), strict=True))
    nose = away(shoulder, pose["trunk"], HEAD)
    points = [(nose[0] + NOSE, nose[1])]
    for part, (px, py) in middle.items():
        points += [(px - OFFSETS[part] + (pose["step"] if part == "wrist" else 0), py), (px + OFFSETS[part], py)]
    x, y = (np.stack([p[k] for p in points], axis=1) for k in (0, 1))
    left, right = JOINTS.index("left_wrist"), JOINTS.index("right_wrist")
    ox, oy = ((v[:, left] + v[:, right])[:, None] / 2 for v in (x, y))
    cos, sin = np.cos(sway)[:, None], np.sin(sway)[:, None]
    x, y = ox + cos * (x - ox) - sin * (y - oy), oy + sin * (x - ox) + cos * (y - oy)
    keys = [hashlib.md5(f"{seed}:{clip_id}:{f}:{j}".encode()).hexdigest() for f in range(len(t)) for j in JOINTS]
    one, two = (np.array([(int(k[a : a + 8], 16) + 0.5) / 4294967296 for k in keys]).reshape(x.shape) for a in (0, 8))
    r = np.sqrt(-2 * np.log(one))
    x, y = size * (x + story.jitter * r * np.cos(2 * np.pi * two)), size * (y + story.jitter * r * np.sin(2 * np.pi * two))
    seen = np.tile([SEEN[j.split("_")[0]] for j in JOINTS], (len(t), 1))
    contact = np.zeros(len(t), bool)
    for kind, first, after, joint, delta in failing(story, nth):
        if kind == "outlier":
            x[first, JOINTS.index(joint)] += delta * size
        elif kind == "contact":
            contact[first:after] = True
        elif kind == "low_visibility":
            seen[first:after] = LOW_VISIBILITY
        else:
            x[first:after] = y[first:after] = seen[first:after] = np.nan
    per = len(JOINTS)
    flat = lambda v: np.round(v.reshape(-1), DIGITS)
    return {
        "frame_idx": np.repeat(np.arange(len(t)), per), "t_ms": np.repeat(t_ms, per), "joint": np.tile(JOINTS, len(t)),
        "x": flat(x), "y": flat(y), "visibility": flat(seen), "trainer_contact": np.repeat(contact, per),
    }


class ClipRange(InputPartition):
    def __init__(self, first: int, after: int):
        self.first, self.after = first, after


class ClipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.clips, self.seed, self.parts = (int(options.get(k, d)) for k, d in (("clips", "100"), ("seed", "1"), ("partitions", "8")))
        self.size = float(options.get("size", "1.0"))
        if self.clips < 0 or self.parts < 1:
            raise ValueError("clips must be 0 or more and partitions 1 or more")

    def partitions(self) -> list[ClipRange]:
        n = max(1, min(self.parts, self.clips))
        return [ClipRange(self.clips * i // n, self.clips * (i + 1) // n) for i in range(n)]

    def read(self, partition: ClipRange) -> Iterator[pa.RecordBatch]:
        for clip_id in range(partition.first, partition.after):
            columns = drawn_clip(clip_id, self.seed, self.size)
            n = len(columns["frame_idx"])
            numbers = {k: pa.array(columns[k], pa.float64(), from_pandas=True) for k in ("x", "y", "visibility")}
            yield pa.RecordBatch.from_pydict(
                {
                    "clip_id": pa.array(np.full(n, clip_id), pa.int64()), "case": pa.array([NAMES[clip_id % len(NAMES)]] * n), "frame_idx": pa.array(columns["frame_idx"], pa.int64()),
                    "t_ms": pa.array(columns["t_ms"], pa.int64()), "joint": pa.array(columns["joint"].tolist()), **numbers, "trainer_contact": pa.array(columns["trainer_contact"]),
                }
            )


class ClipSource(DataSource):
    """ORC6: seeded clips numbered from 0, dealt by ranges of their ids; options clips, seed, size and partitions."""

    @classmethod
    def name(cls) -> str:
        return "pose_clips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ClipReader:
        return ClipReader(dict(self.options))
