"""Importance resampling towards a target corpus, by hashed n-gram features read with a byte automaton.

Texts are never split into strings. Each Arrow batch's UTF-8 buffer is mapped through two lookup
tables (case folding and word bytes), word boundaries are the places where the class of neighbouring
bytes differs, and the CRC-32 of all words advances together, one byte of each a step, through
the 256-entry table. A feature's bucket is its CRC modulo ``buckets``; a document's weight is the floored mean
of its features' gains, the log ratios of smoothed bucket shares in the target and in the corpus.
Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

Bucket counts are summed in each task first, so that at most ``buckets`` rows a task are shuffled; the
gains are one array of ``buckets`` numbers. Ranks come from a range partitioning of the rows at or above
the cut, numbered inside each partition and shifted by the rows of those before: no task holds a rank's
neighbours but its own range.

Defined results: null and empty texts have no features and weigh 0; a null id draws its noise as the
empty text and ranks before other ids of its score. Repeated rows are drawn each, with
the same score, in any order among themselves. Without target texts all gains follow the corpus alone;
an empty corpus gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import read, stored

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text that a task holds in working arrays at once; a longer text goes alone.
SLICE_BYTES = 4_000_000
#: Bytes of a word that all words advance through together; the rest of longer ones goes on from the state reached.
TOGETHER = 256


def _crc_table() -> np.ndarray:
    """The CRC-32 table of the reflected polynomial 0xEDB88320."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, letters and every byte beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after ``lengths[i]`` bytes of ``data`` from ``starts[i]``, for all i at once."""
    state = state.copy()
    order = np.argsort(lengths, kind="stable")  # the words still running are a suffix
    first = np.searchsorted(lengths[order], np.arange(1, min(TOGETHER, int(lengths.max(initial=0))) + 1))
    for step, at in enumerate(first):
        on = order[at:]
        s = state[on]
        state[on] = CRC[(s ^ data[starts[on] + step]) & 0xFF] ^ (s >> 8)
    for i in np.flatnonzero(lengths > TOGETHER):
        rest = data[starts[i] + TOGETHER : starts[i] + lengths[i]]
        state[i] = zlib.crc32(rest, int(~state[i])) ^ 0xFFFFFFFF
    return state


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each feature, number of words, number of features of each text) for texts ``data[offsets[i]:offsets[i + 1]]``.

    Features are all runs of 1 to ``run`` consecutive words joined by one space, ordered by text.
    """
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IN_WORD[data]
    step = np.diff(inside)
    begins, ends = step[:-1] == 1, step[1:] == -1
    # a word ends with its text, though the next text's bytes follow
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts] == 1
    ends[cuts - 1] |= inside[1:-1][cuts - 1] == 1
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) - bounds[:-1][text]
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    found, owner = [state], [text]
    on = np.arange(len(starts))
    for k in range(1, run):
        keep = place[on] + k < n_words[text[on]]
        on, state = on[keep], state[keep]
        state = advance(CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8), data, starts[on + k], lengths[on + k])
        found.append(state)
        owner.append(text[on])
    crc, of = np.concatenate(found) ^ np.uint32(0xFFFFFFFF), np.concatenate(owner)
    if run > 1:
        crc = crc[np.argsort(of, kind="stable")]
    return crc, n_words, np.bincount(of, minlength=len(n_words)).astype(np.int64)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of stretches of about ``SLICE_BYTES`` bytes."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, held = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n) of all texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                total += np.bincount(features(data, offsets, run)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from the bucket counts of both sides: ``buckets`` numbers."""
    source, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for side, counts in ((source, corpus), (aim, target)):
        for r in counts.collect():
            side[r["bucket"]] = r["n"]
    ratio = (aim + 1.0) * (float(source.sum()) + buckets) / ((source + 1.0) * (float(aim.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, run: int = RUN) -> DataFrame:
    """(id, n_words, n_features, weight) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            for row, end, data, offsets in slices(b.column(1)):
                crc, n_words, n = features(data, offsets, run)
                total = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                ends = np.cumsum(n)
                weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight.astype(np.int64))], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"id {kind.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, numbered by ranges of it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(seen + 1, seen + 1 + b.num_rows, dtype=np.int64)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at)], names=[*b.schema.names, "_part", "_at"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, f"{fields}, _part int, _at long"), "ranks")
    # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_part").agg(F.max("_at").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def target_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, run: int = RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """A row for each document (id, n_words, n_features, weight, score, rank): rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run), buckets)
    scored = weighed(docs, gain, id_col, text_col, run).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    # scores are whole thousandths of a logarithm: some ten thousand distinct ones at any size
    tally = scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")))
    total = tally.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    cut = tally.withColumn("above", above).where(F.col("above") >= drawn).agg(F.max("score")).first()[0] if drawn else None
    chosen = enough & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    chosen = F.coalesce(chosen, F.lit(False))
    order = ranked(scored.where(chosen), [F.desc("score"), F.asc_nulls_first("id"), F.asc("_row")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return order.withColumn("rank", rank).unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))).drop("_row")


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = target_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The CRC table and the CRCs of distinct words are computed in SQL.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
item_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocab AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)),
coded AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda s, b: xor(t[xor(s, b) % 256 + 1], s >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM vocab, crc_table),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN coded USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM item_words JOIN coded USING (w) GROUP BY 1),
gain AS MATERIALIZED (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
summed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM doc_words JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN summed USING (doc_id)),
placed AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= 10 * many // 100 THEN nth END AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM placed)
"""
