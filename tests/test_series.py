"""Folds of many series at once, and the pose chain's plan: its samples are not drawn or exchanged again and again."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import kernels, people, runs
from plumbline.plans import pose
from plumbline.sources import clips


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(spark, n):
    return clips.clips(spark.range(n).select(F.col("id").alias("clip_id"), F.lit("line_hold").alias("case"), F.lit(1).alias("seed"), F.lit(1.0).alias("size")))


def test_drawn_clips_are_dealt_over_partitions(spark):
    # one file of seeds is one partition
    assert drawn(spark, 40).select("clip_id").distinct().count() == 40
    assert clips.dealt(spark.range(40).coalesce(1).withColumnRenamed("id", "clip_id")).rdd.getNumPartitions() > 1


def test_only_frames_are_exchanged_between_drawing_and_phases(spark):
    text = plan(pose.classify(pose.signals(pose.clean(drawn(spark, 40)))))
    # samples are drawn once for the lengths and once for the chain, where the seeds are; only frames are exchanged
    assert text.count("REPARTITION_BY_NUM") == 2 and text.count("ENSURE_REQUIREMENTS") <= 2 and text.count("SortMergeJoin") <= 1


def test_hold_runs_read_their_rows_once(spark):
    rows = spark.range(40).select(F.lit(1).alias("k"), (F.col("id") * 0.1).alias("t"), "id", (F.col("id") % 20 > 4).alias("holding"), F.lit(False).alias("event"))
    held = runs.hold_runs(rows, ["k"], "t", "id", "holding", "event", 0.3, 0.3)
    assert plan(held).count("Range (") == 1
    assert [r.hold_id for r in held.orderBy("id").collect()] == [-1] * 5 + [0] * 15 + [-1] * 5 + [1] * 15


def series(spark, seed=5):
    draw = random.Random(seed)
    rows = []
    for k in range(30):
        for i in range(draw.choice((1, 2, 7, 40))):
            x = None if draw.random() < 0.1 else draw.uniform(-1, 1)
            rows.append((None if k == 3 else k, i // 2 * 0.1, i, x, draw.choice((True, True, False, None)) and x is not None))
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, t double, i long, x double, ok boolean")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_speed_outliers_of_many_series_equal_a_loop(spark):
    rows, df = series(spark)
    found = {(r.k, r.i): r.kept for r in kernels.remove_speed_outliers(df, ["k"], "t", "i", "x", "x", "ok", 1.0, 6.0).collect()}
    assert len(found) == len(rows)
    for k, part in by_key(rows).items():
        last = None
        for _, t, i, x, ok in part:
            keep = bool(ok) and not (last and t > last[0] and math.hypot(x - last[1], x - last[1]) / (t - last[0]) > 6.0)
            last = (t, x) if keep else last
            assert found[k, i] == keep


def test_hysteresis_of_many_series_equals_a_loop(spark):
    rows, df = series(spark)
    found = {(r.k, r.i): r.rotated for r in kernels.switch_with_hysteresis(df.withColumn("s", F.lit(True)), ["k"], "t", "i", "x", "s", 0.1, 0.1).collect()}
    for k, part in by_key(rows).items():
        state, since = True, None
        for _, t, i, x, _ok in part:
            if x is None or abs(x) <= 0.1 or (x > 0) == state:
                since = None
            elif since is None:
                since = t
            elif t - since >= 0.1:
                state, since = not state, None
            assert found[k, i] == state


def test_picks_take_no_pandas_group_a_clip(spark, monkeypatch):
    from pyspark.sql import GroupedData

    from plumbline.operators import sampling

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = [(c, i, i * 100, sampling.STRATA[i % 2], 0, 3900, "d", True) for c in range(5) for i in range(40)]
    pool = spark.createDataFrame(rows, "clip_id long, frame_idx long, t_ms long, stratum string, start_ms long, end_ms long, session_date string, inverted boolean")
    picks = sampling.budgeted_picks(pool, {sampling.STRATA[0]: 7, sampling.STRATA[1]: 6}, seed=1, spacing=500).collect()
    assert [sum(r.stratum == s for r in picks) for s in sampling.STRATA[:2]] == [7, 6]


def test_a_sample_is_digested_once_and_no_filter_is_inferred(spark):
    text = plan(drawn(spark, 40))
    assert text.count("md5(") == 1 and "Filter (size(array(" not in text


def test_series_are_whole_however_batches_cut_them(monkeypatch):
    monkeypatch.setattr(kernels, "FOLDED", 5)
    lengths = [1, 3, 12, 2, 2, 1, 7, 1]
    begins = [i == 0 for n in lengths for i in range(n)]
    rows = pa.table({"_begins": begins, "i": list(range(len(begins)))})
    for size in (1, 2, 5, 100):
        parts = list(kernels._whole_series(iter(rows.to_batches(max_chunksize=size))))
        assert all(p["_begins"][0].as_py() for p in parts) and pa.concat_tables(parts).equals(rows)
        assert size > 5 or len(parts) > 2


def test_frames_are_hashed_not_sorted_together(spark):
    text = plan(pose.signals(pose.clean(drawn(spark, 40))))
    assert "SortAggregate" not in text and "collect_list" not in text


def one_way(frames):
    """Number, person and score of each frame of (number, people) by a plain loop; people are (person, x, y, still) in order."""
    hip, out = None, {}
    for n, group in frames:
        found = []
        for p, x, y, still in group:
            near = 1.0 if hip is None or x is None else max(0.0, min(1.0, 1 - math.hypot(x - hip[0], y - hip[1]) / 50.0))
            found.append((still + people.CONTINUITY * near, p, x, y))
        found.sort(key=lambda r: (-r[0], r[1]))
        (score, p, x, y), second = found[0], found[1][0] if len(found) > 1 else -math.inf
        out[n] = (None, score)
        if score >= people.LEAST_SCORE and score - second > people.MARGIN:
            out[n] = (p, score)
            hip = hip if x is None else (x, y)
    return out


def crowds(seed=2):
    draw = random.Random(seed)
    return [
        (c, n, p, None if draw.random() < 0.1 else draw.uniform(0, 100), draw.uniform(0, 100), draw.uniform(0, 50), 50.0, draw.choice((None, 0.1, 0.9)), draw.random() < 0.4)
        for c in range(6) for n in range(draw.choice((1, 5, 40))) for p in range(draw.choice((1, 2, 6)))
    ]


def test_the_athlete_is_swept_without_a_pandas_group_a_clip(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = crowds()
    df = spark.createDataFrame(rows, "clip int, frame long, person int, hip_x double, hip_y double, wrist_y double, length double, visibility double, inverted boolean").repartition(3)
    chosen = people.choose_athlete(df, ["clip"], "frame", "person")
    found = {(r.clip, r.frame): (r.person, r.score) for r in chosen.collect()}
    frames = {}
    for c, n, p, x, y, wrist, length, vis, up in rows:
        frames.setdefault(c, {}).setdefault(n, []).append((p, x, y, wrist, vis, up))
    for c, of in frames.items():
        still = lambda g: [(p, x, y, people.INVERSION * up + people.SUPPORT * max(0.0, min(1.0, 1 - (max(q[3] for q in g) - w) / 50.0)) + people.VISIBILITY * (v or 0.0)) for p, x, y, w, v, up in g]
        ready = [(n, still(g)) for n, g in sorted(of.items())]
        there, back = one_way(ready), one_way(ready[::-1])
        for n in of:
            a, b = there[n], back[n]
            want = a if a[1] > b[1] else b if b[1] > a[1] or b[0] is not None else a
            assert found[c, n][0] == want[0] and abs(found[c, n][1] - want[1]) < 1e-12
    assert len(found) == sum(map(len, frames.values())) and any(p is None for p, _ in found.values()) and any(p for p, _ in found.values())


def test_a_clip_is_swept_in_parts(monkeypatch):
    draw = random.Random(4)
    rows = [(c, n, p, draw.uniform(0, 100), draw.uniform(0, 100), 50.0, draw.uniform(0, 0.7), p == 0) for c in (1, None, 2) for n in range(30) for p in range(draw.choice((1, 3)))]
    table = pa.table(dict(zip(("clip", "frame", "person", "hip_x", "hip_y", "length", "still", "_begins"), zip(*rows, strict=True), strict=True)))
    sweep = lambda size: [b for b in people._swept(iter(table.to_batches(max_chunksize=size)), ["clip"], "frame", "person")]
    whole = sweep(1000)
    monkeypatch.setattr(kernels, "FOLDED", 5)
    parts = sweep(2)
    assert len(parts) > 20 > len(whole)
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches(whole).combine_chunks())
