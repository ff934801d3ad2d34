"""Quality classifier: naive Bayes scaled n-gram indicators under a linear hinge-loss model.

A document is the set of its word unigrams and bigrams, hashed to ``2**BITS`` ids by Spark.
The model multiplies each indicator by the log ratio of its smoothed frequencies in the two
classes, and fits a linear support vector machine to the products by dual coordinate descent. Frequencies
are taken within each class. Cost and bias are chosen on an inner fold of the training sample; no held-out row takes
part in anything.

Defined results: null and empty texts have no n-grams and score what the bias says; labels that
are null or neither 0 nor 1 are ignored; with labels of one class or none, every score is
the smoothed share of class 1. Repeated rows are scored each; columns of the input named score or
predicted give way to ours. Copies of a label row count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import let, read, words

#: Ids of hashed n-grams.
BITS = 18
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
#: Passes of dual coordinate descent.
PASSES = 12
#: Upper bounds on the dual variables, of which an inner fold of the sample (every ``INNER``-th row by hash) takes the best;
#: the middle one where a fold is too small to tell.
COSTS = (0.125, 0.25, 0.5, 1.0, 2.0)
INNER, LEAST_INNER = 5, 100
#: Biases, of which the inner fold takes one, and the share of its rows of class 1 that a bias has to keep.
BIASES, KEEP = np.round(np.arange(-0.5, 0.501, 0.02), 2), 0.99
SMOOTHING = 1.0
#: Log odds by margin.
SLOPE = 2.0


def ngram_ids(text: Column, bits: int = BITS) -> Column:
    """The distinct ids of a text's unigrams and bigrams."""
    mask = F.lit((1 << bits) - 1).cast("long")

    def ids(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.array_distinct(F.transform(F.concat(h, pairs), lambda x: x.bitwiseAND(mask).cast("int")))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), ids)


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, seed: int = 7, cost: float = COSTS[len(COSTS) // 2]) -> tuple[np.ndarray, float]:
    """Weights by n-gram id, and the log odds of a text without any (0, unless all labels are of one class)."""
    size = 1 << bits
    share = (labels.sum() + SMOOTHING) / (len(labels) + 2 * SMOOTHING) if len(labels) else 0.5
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    counts = [np.full(size, SMOOTHING), np.full(size, SMOOTHING)]
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y)][ids] += 1
    ratio = np.log(counts[1] / (labels.sum() + 2 * SMOOTHING)) - np.log(counts[0] / ((1 - labels).sum() + 2 * SMOOTHING))
    # by the root of a text's n-grams, so that long texts do not rule the margin
    xs = [ratio[ids] / np.sqrt(max(len(ids), 1)) for ids in rows]
    square = [float(x @ x) for x in xs]
    sign = 2.0 * labels - 1
    alpha, w = np.zeros(len(rows)), np.zeros(size)
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            ids, x = rows[i], xs[i]
            if not square[i]:
                continue
            margin = sign[i] * (w[ids] @ x)
            step = min(max(alpha[i] + (1 - margin) / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[ids] += step * sign[i] * x
    return (w * ratio).astype(np.float32), 0.0


def margins(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([weights[ids].sum() / np.sqrt(max(len(ids), 1)) for ids in rows])


def best_bias(margin: np.ndarray, labels: np.ndarray) -> float:
    """Of ``BIASES`` that keep ``KEEP`` of the rows of class 1 (or as many as any does) the one that rejects most of class 0; the nearest to 0 on a tie."""
    kept = np.array([np.mean(margin[labels == 1] + b >= 0) for b in BIASES])
    gone = np.array([np.mean(margin[labels == 0] + b < 0) for b in BIASES])
    fit = kept >= min(KEEP, kept.max())
    order = np.lexsort((np.abs(BIASES), -gone, ~fit))
    return float(BIASES[order[0]])


def best_settings(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[float, float]:
    """(cost, bias): the cost whose weights, fitted without the inner fold, tell its classes apart best (the mean of the shares of each class that are
    right without a bias; the least on a tie), and the bias that suits those weights on the inner fold."""
    inner = np.arange(len(rows)) % INNER == 0
    if inner.sum() < LEAST_INNER or len(np.unique(labels[inner])) < 2:
        return COSTS[len(COSTS) // 2], 0.0
    best = (-1.0, 0.0, 0.0)
    for cost in COSTS:
        margin = margins(fit_weights([rows[i] for i in np.flatnonzero(~inner)], labels[~inner], bits, cost=cost)[0], [rows[i] for i in np.flatnonzero(inner)])
        right = float(np.mean([((margin >= 0)[labels[inner] == y] == y).mean() for y in (0, 1)]))
        if right > best[0]:
            best = (right, cost, best_bias(margin, labels[inner]))
    return best[1:]


def fit(labelled: DataFrame, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights, bias) from rows (ids, label): one task fits the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, keys = [], [], []
        for b in batches:
            rows += [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in b.column("ids")]
            labels += b.column("label").to_pylist()
            keys += b.column("key").to_pylist()
        at = sorted(range(len(rows)), key=lambda i: (keys[i], len(rows[i])))
        rows, truth = [rows[i] for i in at], np.array([labels[i] for i in at], np.float64)
        cost, bias = best_settings(rows, truth, bits)
        w, alone = fit_weights(rows, truth, bits, cost=cost)
        bias += alone
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary()), "bias": [bias]})

    got = labelled.repartition(1).mapInArrow(run, "w binary, bias double").first()
    if got is None:  # a table without partitions runs no task
        return fit_weights([], np.zeros(0), bits)
    return np.frombuffer(bytes(got["w"]), np.float32).copy(), got["bias"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS):
    """A model from a bounded sample of the labelled rows; ``labels`` holds training rows only."""
    key = F.xxhash64(F.col(id_col))
    sample = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), key.alias("key"))
        .orderBy("key", "_id", "label")
        .limit(sample_rows)
    )
    # at most ``sample_rows`` rows of three numbers
    rows = docs.select(F.col(id_col).alias("_id"), text_col).join(F.broadcast(sample), "_id")
    return fit(rows.select("key", "label", ngram_ids(F.col(text_col)).alias("ids")))


def with_quality_scores(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (or all columns but the text) with ``score`` in 0..1 and ``predicted``."""
    weights, bias = model
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted") and (keep or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            ids = b.column("_ids")
            lengths = np.diff(np.asarray(ids.offsets))
            total = np.concatenate([[0.0], np.cumsum(w[np.asarray(ids.flatten())], dtype=np.float64)])
            ends = np.cumsum(lengths)
            sums = total[ends] - total[ends - lengths]
            margin = bias + sums / np.sqrt(np.maximum(lengths, 1))
            score = 1 / (1 + np.exp(-np.clip(SLOPE * margin, -500, 500)))
            columns = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "score", "predicted"])

    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*keep, ngram_ids(F.col(text_col)).alias("_ids")).mapInArrow(score, schema)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(fold() != 1))
    held = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return with_quality_scores(held, model)
