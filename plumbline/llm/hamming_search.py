"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred (which keeps the order of inner products for every query) and lifted by one coordinate
to equal length, so that the largest inner product is the smallest angle; rotations learned on a
bounded sample, each the orthogonal map that brings the sample nearest to its own signs, turn a
vector into ``BITS`` bits. Codes are cut into bytes and each byte position is indexed by its value. Two codes
within Hamming radius r agree within r // m bits in one of the m bytes at least (in one of the first r % m + 1
bytes, or within one bit less in another), so probing all values within those bits of the query's bytes finds every code
within r; those are counted exactly and reranked by inner products of the original vectors in double precision.

The radius is the least at which ``AIM`` of the true neighbours in the sample lie inside; where a block of
the index has fewer codes than neighbours asked for, the query widens its radius there. Every
row is indexed, in blocks of about ``BLOCK_ROWS`` vectors; queries meet the blocks in blocks of ``QUERY_ROWS``.
Of equal vectors the ``k + 1`` smallest ids are indexed and one is searched for: no more can be among the answers.

Defined results: null or zero vectors, and those with null or non-finite components or another length than
that of most rows (the shorter on a tie) neither ask nor answer. Rows equal in id and vector count once; a query's own
id is no candidate. Fewer than ``k`` candidates are all found. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import read, stored

K = 20
#: Rows that the rotations and the radius are learned from, at most: those with the smallest hash of their id; queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 256
BITS, ROUNDS, AIM = 128, 15, 0.97
BLOCK_ROWS, QUERY_ROWS = 16_384, 1_024
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Byte masks of at most r bits, by r.
MASKS = [np.flatnonzero(POPCOUNT <= r).astype(np.uint8) for r in range(9)]


@dataclass
class Coder:
    """How vectors become codes, and the radius that holds most true neighbours."""

    mean: np.ndarray
    longest: float
    rotations: list[np.ndarray]
    radius: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def bits(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(np.column_stack([lifted @ r > 0 for r in self.rotations])[:, :BITS], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self.bits(self.lifted(x))

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Codes of queries: only their direction counts."""
        return self.bits(np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]))


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return POPCOUNT[codes ^ code].sum(-1, dtype=np.int64)


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """An orthogonal map under which the rows come close to their signs, from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ v
    return r


def learn(sample: np.ndarray, mean: np.ndarray, longest: float, k: int = K) -> Coder:
    """Rotations and radius from a sample of vectors."""
    coder = Coder(mean, longest or 1.0, [])
    x = coder.lifted(sample)
    coder.rotations = [rotation(x, seed) for seed in range(-(-BITS // x.shape[1]))]
    codes, queries = coder.codes(sample), sample[:SAMPLE_QUERIES]
    near = []
    for i, (q, code) in enumerate(zip(queries, coder.asked(queries), strict=True)):
        score = sample @ q
        score[i] = -np.inf
        near.append(distances(codes[np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]], code))
    all_near = np.sort(np.concatenate(near)) if near else np.zeros(0)
    coder.radius = int(all_near[int(np.ceil(AIM * len(all_near))) - 1]) if len(all_near) else BITS
    return coder


class Index:
    """A block of codes, indexed by the value of each byte."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        self.ends = np.stack([np.cumsum(np.bincount(column, minlength=256)) for column in codes.T])
        self.starts = self.ends - np.stack([np.bincount(column, minlength=256) for column in codes.T])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        hit = np.zeros(len(self.codes), bool)
        bytes_, (each, more) = len(code), divmod(radius, len(code))
        for i in range(bytes_):
            bits = min(each, 8) if i <= more else min(each - 1, 8)
            if bits < 0:
                continue
            values = MASKS[bits] ^ code[i]
            starts, n = self.starts[i][values], (self.ends[i] - self.starts[i])[values]
            at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
            hit[self.order[i][at]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], code) <= radius]

    def nearest(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows within ``radius``, widened until ``least`` rows are inside."""
        found = self.within(code, radius)
        while len(found) < min(least, len(self.codes)):
            radius += len(code)
            found = self.within(code, radius)
        return found


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that equal vectors have equal scores wherever they lie."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * q[i]
    return total


def block_answers(index: Index, ids: np.ndarray, x: np.ndarray, q: np.ndarray, codes: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's ``k`` best rows of a block among those within the radius."""
    which, found, scores = [], [], []
    for j, code in enumerate(codes):
        rows = index.nearest(code, radius, k)
        rough = x[rows] @ q[j]
        if len(rows) > k:
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            rows = rows[rough >= edge - 1e-9 * (1 + abs(edge))]
        exact = dot(x[rows], q[j])
        best = np.lexsort((ids[rows], -exact))[:k]
        which.append(np.full(len(best), j))
        found.append(ids[rows[best]])
        scores.append(exact[best])
    return np.concatenate(which), np.concatenate(found), np.concatenate(scores)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, once each."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.where(finite)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0)).dropDuplicates(["vec_id", "v"])


def neighbours(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``asks`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    top = Window.partitionBy("v").orderBy("vec_id")
    # the k + 1 smallest ids of equal vectors, cut before the shuffle
    index = stored(rows.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth"), "indexed")
    asking = rows.where(asks)
    queries = stored(asking.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    n, n_queries = index.count(), queries.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    doubles = F.transform("v", lambda c: c.cast("double"))
    dim = index.select(F.size("v")).first()[0]
    mean = [r["m"] for r in rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m")).orderBy("pos").collect()]  # a number a component
    centred = F.aggregate(F.zip_with(doubles, F.lit(mean), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, c: s + c)
    longest = float(index.agg(F.max(F.sqrt(centred))).first()[0])
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select(doubles.alias("v")).toPandas()["v"]
    coder = learn(np.array(sample.tolist()).reshape(len(sample), dim), np.array(mean), longest, k)
    shared = spark.sparkContext.broadcast(coder)

    blocks, query_blocks = -(-n // BLOCK_ROWS), -(-n_queries // QUERY_ROWS)
    dealt = lambda df, key, many, others, name: df.select(key, "v", F.pmod(F.xxhash64(key), F.lit(many)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
    left = dealt(index, "vec_id", blocks, query_blocks, "block").select("block", F.col("other").alias("ask"), "vec_id", "v")
    right = dealt(queries, "query", query_blocks, blocks, "ask").select(F.col("other").alias("block"), "ask", "query", "v")

    def answer(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asked.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
        held = held.sort_values("vec_id", kind="stable")
        ids, x = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.float64)
        q = np.stack(asked["v"].to_numpy()).astype(np.float64)
        coder = shared.value
        which, found, score = block_answers(Index(coder.codes(x)), ids, x, q, coder.asked(q), coder.radius, k + 1)
        return pd.DataFrame({"query": asked["query"].to_numpy()[which], "vec_id": found, "score": score})

    got = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInPandas(answer, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # one more than k, as a query's own id may be among them
    answers = stored(got.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1), "answers")
    askers = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), "query")
    own = F.max(F.when(F.col("vec_id") == F.col("query_id"), F.col("nth"))).over(Window.partitionBy("query_id", "query"))
    out = askers.join(answers, "query").withColumn("own", own).where("vec_id <> query_id")
    rank = F.col("nth") - F.when(F.col("own") < F.col("nth"), 1).otherwise(0)
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
