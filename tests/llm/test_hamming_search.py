"""Multi-index hashing: probing is exact within its radius, and recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hamming_search as hs

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    """The k nearest of each query among usable rows, in doubles."""
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            scored = sorted((-float(hs.dot(x[i][None], x[q])[0]), i) for i in x if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    for width in (1, 4, 16):
        codes = rng.integers(0, 256, (400, width)).astype(np.uint8)
        codes[:50] = codes[0]
        index = hs.Index(codes)
        for radius in (0, 1, width - 1, width, 3 * width + 2, 8 * width):
            for code in codes[::90]:
                assert set(index.within(code, radius)) == set(np.flatnonzero(hs.distances(codes, code) <= radius))
        assert len(index.nearest(codes[60] ^ 255, 0, 30)) >= 30


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_recall_on_vectors_of_all_lengths(spark, monkeypatch, coalesced):
    # blocks of both sides must meet though they lie in other partitions
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        check_recall(spark, monkeypatch)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def check_recall(spark, monkeypatch):
    monkeypatch.setattr(hs, "BLOCK_ROWS", 700)
    monkeypatch.setattr(hs, "QUERY_ROWS", 40)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.2, 3, (3000, 1)) + 0.7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(hs.neighbours(spark.createDataFrame([(*r, 0, 0) for r in rows], f"{SCHEMA}, query long, nth long"), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert recall(got, want) >= 0.9
    for q in want:
        true = dict(want[q])
        assert [p for p in got[q] if p[0] in true] == [p for p in want[q] if p[0] in dict(got[q])]


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8).tolist()
    rows = [(i, one) for i in range(60)] + [(100 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    bad = [(200, None), (201, [0.0] * 8), (202, [None, *one[1:]]), (203, [float("nan"), *one[1:]]), (204, [float("inf"), *one[1:]]), (205, one[:3]), (None, one), (220, [])]
    got = found(hs.neighbours(spark.createDataFrame([*rows, *rows[:5], *bad], SCHEMA).repartition(3), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in (0, 20, 40):
        assert got[q] == want[q] and [i for i, _ in got[q]] == [i for i in range(22) if i != q][:20]
    assert recall(got, want) >= 0.9


def test_few_and_no_candidates(spark):
    few = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert found(hs.neighbours(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 20 == 0)) == brute(few)
    assert found(hs.neighbours(spark.createDataFrame(few[:1], SCHEMA), F.col("vec_id") % 20 == 0)) == {}
    assert hs.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
