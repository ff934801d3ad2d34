"""Segment merging, cluster draws, session cues and gates against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import comparison, runs, scoring, stats
from plumbline.operators.orders import running_totals


def loop_merge(found, least):
    found = [list(r) for r in found]
    while len(found) > 1:
        sizes = [e - s for _, s, e in found]
        i = sizes.index(min(sizes))
        if sizes[i] >= least:
            break
        j = 1 if i == 0 else i - 1 if i == len(found) - 1 or sizes[i + 1] <= sizes[i - 1] else i + 1
        found[i][0] = found[j][0]
        out = [found[0]]
        for r in found[1:]:
            if r[0] == out[-1][0]:
                out[-1][2] = r[2]
            else:
                out.append(r)
        found = out
    return [tuple(r) for r in found]


def test_heap_merges_as_the_loop_does():
    r = random.Random(1)
    for _ in range(300):
        t, found = 0, []
        for _ in range(r.randint(1, 14)):
            label = r.choice([x for x in "abc" if not found or x != found[-1][0]])
            size = r.choice([0, 0, 1, 1, 2, 3, 7])
            found.append((label, t, t + size))
            t += size + r.choice([0, 1])
        for least in (0, 1, 2, 5, 100):
            assert runs.merged_runs(found, least) == loop_merge(found, least)


def test_many_runs_take_no_square_of_steps():
    found = [("ab"[i % 2], 2 * i, 2 * i + 1) for i in range(200_000)]
    assert len(runs.merged_runs(found, 3)) < 200_000


def test_draws_are_a_multinomial(spark):
    rows = [(g, c) for g, n in (("a", 7), ("b", 1), ("c", 40)) for c in range(n)]
    placed = running_totals(spark.createDataFrame(rows, "g string, c long").withColumn("one", F.lit(1)), ["g", "c"], ["one"])
    ends = placed.groupBy("g").agg(F.count(F.lit(1)).alias("of"), F.min("total_one").alias("a"))
    numbered = placed.join(ends, "g").select("g", (F.col("total_one") - F.col("a")).alias("nth"), "of")
    draws = stats.cluster_draws(numbered, ["g"], "c", 400, 5).toPandas()
    for g, n in (("a", 7), ("b", 1), ("c", 40)):
        own = draws[draws["g"] == g]
        assert set(own.groupby("sample")["times"].sum()) == {n} and own["sample"].nunique() == 400
        share = own.groupby("nth")["times"].sum() / (400 * n)
        assert len(share) == n and abs(share - 1 / n).max() < 5 * ((1 / n) * (1 - 1 / n) / (400 * n)) ** 0.5 + 1e-12


def test_intervals_cover_the_truth(spark):
    # 60 tables of 40 clusters whose hit share is 0.4; nominal coverage is 95 percent
    r = random.Random(3)
    rows = [(t, c, int(r.random() < 0.4 + 0.3 * ((c % 2) - 0.5))) for t in range(60) for c in range(40) for _ in range(8)]
    got = stats.bootstrap_ratio(spark.createDataFrame(rows, "t long, c long, hit long").withColumn("one", F.lit(1)), "c", "hit", "one", ["t"], samples=300).collect()
    assert sum(x.low <= 0.4 <= x.high for x in got) >= 50 and all(x.low <= x.ratio <= x.high for x in got)
    whole = stats.bootstrap_ratio(spark.createDataFrame(rows, "t long, c long, hit long").withColumn("one", F.lit(1)), "c", "hit", "one", [], samples=50).collect()
    assert len(whole) == 1 and whole[0].low < 0.4 < whole[0].high


def test_gates_in_one_pass(spark):
    rows = [(c, s / 10, 100.0, 60.0 if c != "b" else None) for c in "abc" for s in range(10) for _ in range(3 if c == "a" else 1)]
    got = {x.gate: x.unusable for x in comparison.unusable_clips(spark.createDataFrame(rows, "clip_id string, s double, x double, y double"), ["x", "y"], "s", [0.0, 0.5, 0.8], 10).collect()}
    assert got == {0.0: 1, 0.5: 2, 0.8: 3}


def test_session_cues_by_severity(spark):
    faults = "array<struct<feature: string, value: double, z: double>>"
    scores = spark.createDataFrame(
        [("a", 0, [("banana", -1.0, 2.0), ("hip_angle", 1.0, -9.0), ("head", 1.0, 1.4)]), ("a", 1, [("head", 1.0, 4.0)]), ("b", 0, [("com_forward", 1.0, 3.0), ("banana", 0.0, 3.0)]), ("c", 0, None)], f"clip_id string, hold_id int, top_faults {faults}"
    )
    summary = spark.createDataFrame([("a", 0, 0, 500, 31.0, 30.0), ("a", 1, 600, 700, 0.0, 0.0), ("b", 0, 0, 9, 0.0, None), ("c", 0, 0, 9, 50.0, 50.0)], "clip_id string, hold_id int, start_ms long, end_ms long, pct_over double, pct_under double")
    rows = scoring.session_cues(scores, summary).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.clip_id, x.rank)):
        got.setdefault(x.clip_id, []).append((x.cue, x.severity))
        assert x.text == scoring.CUE_TEXTS[x.cue]
    assert got == {"a": [("hip_angle", 1.0), ("banana_neg", 0.5), ("balance_over", 0.4)], "b": [("none", 0.0)], "c": [("balance_over", 0.4), ("balance_under", 0.4)]}
    limits = summary.withColumns({"hip_angle_median": F.lit(150.0), "banana_median": F.lit(0.2), "head_median": F.lit(0.0)})
    rules = [("hip_angle", F.col("hip_angle_median") < 165, F.lit(0.7)), ("banana", F.abs("banana_median") > 0.05, F.lit(0.9)), ("head", F.lit(None).cast("boolean"), F.lit(1.0))]
    first = [x.cue for x in scoring.session_cues(scores, limits, tolerances=rules).where("clip_id = 'a'").orderBy("rank").collect()]
    assert first == ["banana_pos", "hip_angle", "balance_over"]
    with pytest.raises(KeyError):
        scoring.CUE_TEXTS["com_forward"]
