"""The frame sampler against sequential loops, and order over whole tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sampling
from plumbline.operators.orders import exact_quantiles, running_totals

POOL = "clip_id string, frame_idx long, t_ms long, start_ms long, end_ms long, stratum string, session_date string, inverted boolean"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def a_pool(seed, clips=30, frames=40, held=0.3):
    r = random.Random(seed)
    rows = []
    for c in range(clips):
        day = r.choice(["2026-01-01", "2026-01-02", "2026-01-03", None])
        times = sorted(r.sample(range(0, 20_000), r.randint(1, frames)))
        kinds = r.choice([["clean_no_trainer"], ["clean_trainer", "trainer_contact"], list(sampling.STRATA)])
        rows += [(f"c{c:02}", i, t, times[0], times[-1], r.choice(kinds), day, r.random() < held) for i, t in enumerate(times)]
    return rows


def loop_order(rows, seed):
    """Round-robin over session days."""
    day = {}
    for x in rows:
        day[x[0]] = x[6] or ""
    lines = {}
    for clip in sorted(day, key=lambda c: (md5(f"{seed}:{c}"), c)):
        lines.setdefault(day[clip], []).append(clip)
    days = sorted(lines, key=lambda d: (md5(f"{seed}:{d}"), d))
    return [lines[d][k] for k in range(max(map(len, lines.values()))) for d in days if k < len(lines[d])]


def loop_picks(rows, wanted, seed, per_clip=4, spacing=500):
    left, out = dict(wanted), []
    for clip in loop_order(rows, seed):
        own = [x for x in rows if x[0] == clip]
        a, span = own[0][3], max(own[0][4] - own[0][3], 1)
        key = lambda x: ((b := min((x[2] - a) * per_clip // span, per_clip - 1)), abs(x[2] - (a + span * (b + 0.5) / per_clip)), x[1])
        lines = {s: iter(sorted((x for x in own if x[5] == s), key=key)) for s in sampling.STRATA}
        took, more = [], True
        while more and len(took) < per_clip:
            more = False
            for s in sampling.STRATA:
                if len(took) == per_clip or left.get(s, 0) <= 0:
                    continue
                x = next(lines[s], None)
                if x is not None:
                    more = True
                    if all(abs(x[2] - y[2]) >= spacing for y in took):
                        took.append(x)
                        left[s] -= 1
        out += took
    return out


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 70), (3, 500), (4, 3)])
def test_budgeted_picks_equal_the_loop(spark, seed, n):
    rows = a_pool(seed)
    wanted = dict(zip(sampling.STRATA, sampling.quotas(n), strict=True))
    got = sampling.budgeted_picks(spark.createDataFrame(rows, POOL).repartition(5), wanted, seed)
    want = loop_picks(rows, wanted, seed)
    numbered = spark.createDataFrame([(int(x[0][1:]), *x[1:]) for x in rows], POOL.replace("clip_id string", "clip_id long"))
    assert sampling.budgeted_picks(numbered, wanted, seed).count() == len(sampling.budgeted_picks(numbered, wanted, seed).dropDuplicates(["clip_id", "frame_idx"]).collect())
    ordered = [(r.clip_id, r.frame_idx) for r in got.orderBy("_turn", "_day", "_session", "nth").collect()]
    assert ordered == [x[:2] for x in want]
    for s in sampling.STRATA:
        assert sum(x[5] == s for x in want) <= wanted[s]
    assert n == 500 or sum(x[5] == "clean_no_trainer" for x in want) == wanted["clean_no_trainer"]


def loop_swaps(sample, rows, share=0.7, per_clip=4, spacing=500):
    """One victim after another: own clip first, then clips of the same day, then any, by rank within a class."""
    far = lambda t, times: all(abs(t - u) >= spacing for u in times)
    now = list(sample)
    used = lambda: {x[:2] for x in now}
    need = math.ceil(share * len(now) - 1e-9) - sum(x[7] for x in now)
    start = used()
    given = set()
    for i, v in enumerate(now):
        if need <= 0:
            return now
        if v[7]:
            continue
        others = [x[2] for j, x in enumerate(now) if x[0] == v[0] and j != i]
        fits = [x for x in rows if x[0] == v[0] and x[5] == v[5] and x[7] and x[:2] not in start | given and far(x[2], others)]
        if fits:
            now[i] = min(fits, key=lambda x: (abs(x[2] - v[2]), x[1]))
            given.add(now[i][:2])
            need -= 1
    for by in ((5, 6), (5,)):
        offers = []
        for clip in sorted({x[0] for x in now}):
            times = [x[2] for x in now if x[0] == clip]
            for x in sorted((x for x in rows if x[0] == clip and x[7] and x[:2] not in start | used()), key=lambda x: (x[2], x[1])):
                if len(times) < per_clip and far(x[2], times):
                    times.append(x[2])
                    offers.append(x)
        for clip in sorted({x[0] for x in rows} - {x[0] for x in now}):
            times = []
            for x in sorted((x for x in rows if x[0] == clip and x[7]), key=lambda x: (x[2], x[1])):
                if len(times) < per_clip and far(x[2], times):
                    times.append(x[2])
                    offers.append(x)
        kind = lambda x: tuple(x[k] or "" for k in by)  # noqa: E731, B023
        lines = {}
        for x in sorted(offers, key=lambda x: (x[2], x[0], x[1])):
            lines.setdefault(kind(x), []).append(x)
        before = list(now)
        for i, v in enumerate(before):
            if need > 0 and not v[7] and lines.get(kind(v)):
                now[i] = lines[kind(v)].pop(0)
                need -= 1
    return now


@pytest.mark.parametrize("seed, held", [(5, 0.5), (6, 0.15), (7, 0.9)])
def test_swaps_equal_the_loop_and_keep_the_caps(spark, seed, held):
    rows = a_pool(seed, held=held)
    wanted = dict(zip(sampling.STRATA, sampling.quotas(45), strict=True))
    pool = spark.createDataFrame(rows, POOL).repartition(3)
    sample = loop_picks(rows, wanted, seed)
    got = sampling.swapped_for_holds(sampling.budgeted_picks(pool, wanted, seed), pool).collect()
    want = loop_swaps(sample, rows)
    assert sorted((r.clip_id, r.frame_idx) for r in got) == sorted(x[:2] for x in want)
    for s in sampling.STRATA:
        assert sum(r.stratum == s for r in got) == sum(x[5] == s for x in sample)
    for clip in {r.clip_id for r in got}:
        times = sorted(r.t_ms for r in got if r.clip_id == clip)
        assert len(times) <= 4 and all(b - a >= 500 for a, b in zip(times, times[1:]))
    assert held < 0.5 or sum(r.inverted for r in got) >= 0.7 * len(got)


def test_every_frame_is_in_the_pool_or_in_the_ledger(spark):
    clips = spark.createDataFrame(
        [("a", "line", "d", True, False), ("b", "walk", "d", True, False), ("c", "", "d", True, True), ("e", "line", None, False, True), ("f", "line", "d", True, None), ("g", "tuck", "d", True, True)],
        "clip_id string, skill string, session_date string, has_video boolean, trainer_present boolean",
    )
    frames = spark.createDataFrame([(c, i, 33 * i, i != 1, i == 2, i == 3) for c in "abceg" for i in range(4)], "clip_id string, frame_idx long, t_ms long, detected boolean, trainer_contact boolean, inverted boolean")
    pool = sampling.pooled(frames, clips, ["line"])
    got = {r.excluded_by: (r.clips, r.frames) for r in sampling.ledger(pool).collect()}
    assert got == {"kept": (1, 3), "no person": (1, 1), "walk": (1, 4), "no skill": (1, 4), "no video": (1, 4), "no keypoints": (1, 0), "other skill": (1, 4)}
    unlabelled = sampling.pooled(frames, clips.withColumn("skill", F.lit(None).cast("string")), ["line"])
    assert {r.excluded_by for r in sampling.ledger(unlabelled).collect()} == {"kept", "no person", "no video", "no keypoints"}


def test_running_totals_over_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.randint(-5, 9)) for i in range(500)]
    got = {x.i: x.total_v for x in running_totals(spark.createDataFrame(rows, "i long, v long").repartition(6), ["i"], ["v"]).collect()}
    total = 0
    for i, v in rows:
        total += v
        assert got[i] == total


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 50 + [6.0] * 3, [random.Random(2).gauss(0, 1e6) for _ in range(999)], [0.0, 5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52] * 7])
def test_exact_quantiles_equal_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "v", shares, cells=8)
    plain = sorted(values)
    for q, x in zip(shares, got, strict=True):
        at = q * (len(plain) - 1)
        low, high = plain[int(at)], plain[min(int(at) + 1, len(plain) - 1)]
        assert x == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    assert exact_quantiles(df.where("v > 1e308"), "v", [0.5]) == [None]
