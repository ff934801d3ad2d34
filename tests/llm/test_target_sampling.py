"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import target_sampling as ts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["One two, TWO three", None, "", " \n", "É été ÀB c\x00d", "a" * 1000 + " b" * 30, "日本 語x", "x1y2 [z] {q} ~", "same words here again " * 8, "same words here again " * 8]


def loop_features(text, run):
    words = WORD.findall((text or "").translate(FOLD))
    return [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)], len(words)


def loop_sample(docs, target, run=1, least=20, percent=10, seed=2024, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in loop_features(x, run)[0]:
                side[bucket(f)] += 1
    out = []
    for i, x in docs:
        found, n_words = loop_features(x, run)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [tuple([*r, ranks.get(id(r))]) for r in out]


@pytest.mark.parametrize("run", [1, 2, 3])
def test_automaton_reads_what_a_regex_does(monkeypatch, run):
    import pyarrow as pa

    monkeypatch.setattr(ts, "TOGETHER", 7)
    monkeypatch.setattr(ts, "SLICE_BYTES", 40)
    for column in (pa.array(TEXTS), pa.array(["?", *TEXTS, "?"]).slice(1, len(TEXTS)), pa.array(TEXTS, pa.large_string())):
        rows = []
        for row, end, data, offsets in ts.slices(column):
            crc, n_words, n = ts.features(data, offsets, run)
            parts = np.split(crc, np.cumsum(n)[:-1])
            rows += [(sorted(map(int, p)), int(w)) for p, w in zip(parts, n_words, strict=True)]
        assert rows == [(sorted(zlib.crc32(f.encode()) for f in fs), w) for fs, w in (loop_features(x, run) for x in TEXTS)]


@pytest.mark.parametrize("run, least, percent", [(1, 20, 10), (2, 3, 50)])
def test_draw_equals_a_loop(spark, run, least, percent):
    r = random.Random(5)
    vocabulary = ["the", "of", "Zeta", "été", "x1", "query", "plan", "sort", "join", "data"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(200)] + [(500 + i, x) for i, x in enumerate(TEXTS)] + [(None, "query plan " * 15)]
    target = ["query plan sort join", None, "", "join data plan"]
    # columns whose names clash with the operator's own
    frame = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], "doc_id long, text string, score long, rank long, _at long").repartition(7)
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = {tuple(x) for x in ts.target_sample(frame, aim, run=run, least_words=least, percent=percent).collect()}
    want = loop_sample(docs, target, run, least, percent)
    assert got == set(want) and sum(x[5] is not None for x in want) > 5


def test_repeated_rows_take_ranks_of_their_own(spark):
    frame = spark.createDataFrame([(7, "word " * 25)] * 40 + [(i, "other words " * 12) for i in range(60)], "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(1, "word")], "item_id long, text string")
    got = ts.target_sample(frame, aim, percent=50).collect()
    drawn = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert len(got) == 100 and [x["rank"] for x in drawn] == list(range(1, 51))
    assert [(-x["score"], x["id"]) for x in drawn] == sorted((-x["score"], x["id"]) for x in got)[:50]


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ts.target_sample(docs, aim).collect() == []
    one = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [x["rank"] for x in ts.target_sample(one, aim).collect()] == [None]
