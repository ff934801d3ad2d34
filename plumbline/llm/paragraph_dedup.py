"""Substring dedup: paragraph MinHash banding, exact verification, removal by components.

Paragraphs are of two kinds. Lines of ``LENGTH`` words or more are compared by MinHash: a band is ``ROWS``
minima over the line's word shingles, as many bands as the wanted recall at the threshold takes; lines that
share a band connect candidate groups, in which overlaps of shingles are counted exactly (blocks of a sparse
product, whatever the group's size), and lines at the threshold are linked. Passages pasted into lines have no
marks, so there paragraphs are cut by content: the ``LENGTH`` words from each anchor, and anchors are the
shingles of least hash in any stretch of ``STRETCH``. Copies of a passage have equal anchors wherever they stand, a
passage of ``STRETCH + LENGTH + SHINGLE - 2`` words (43) or more holds a whole paragraph, and since anchors are at
most a paragraph apart those of a long passage leave no gap. So short are cut paragraphs that one changed
word leaves less than the threshold: equal ones are linked, by their hash.

Components of linked paragraphs that stand in two documents or more are repeats: the first occurrence stays, the
others are to be removed.

Defined results: null and empty texts and those shorter than a paragraph hold none; repeats within
one document alone are not repeats across documents; rows of equal id and text are one document, rows of equal id
and different texts are two; a null id is an id; ties of the first occurrence go to the smaller text hash, then place; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import let, read, stored
from plumbline.llm.graph import components
from plumbline.llm.ngram_join import BLOCK, ENTRIES, arrays, linked_in_groups, lowered, mixed, overlaps

SHINGLE = 5
LENGTH = 20
STRETCH = 20
SIMILARITY = 0.8
#: Minima in a band, and the chance with which two lines at the threshold must share a band.
ROWS = 3
RECALL = 0.98

_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15], np.uint64)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands that reach the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def marked_hashes(text: Column) -> Column:
    """Hashes of the words of a text and of its line ends."""
    marked = F.replace(lowered(text), F.lit("\n"), F.lit(" \n "))
    return F.transform(F.array_remove(F.split(marked, "[\\x20\\x09\\x0B-\\x0D]+"), ""), lambda w: F.xxhash64(w))


def _line_end(spark: SparkSession) -> int:
    return spark.range(1).select(F.xxhash64(F.lit("\n"))).first()[0]


def _lines(h: np.ndarray, line_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text, and the starts and ends of its lines of ``LENGTH`` words or more."""
    breaks = h == line_end
    ends = np.append(np.cumsum(~breaks)[breaks], len(h) - breaks.sum())
    starts = np.append(0, ends[:-1])
    long = ends - starts >= LENGTH
    return h[~breaks].view(np.uint64), starts[long], ends[long]


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all word shingles, in order."""
    total = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        total += h[i : len(h) - SHINGLE + 1 + i] * _ODD[i] + np.uint64(i)
    return mixed(total)


def _anchors(s: np.ndarray, last: int) -> np.ndarray:
    """Places of the least shingles of all stretches, up to the last place of a whole paragraph."""
    packed = (s & ~np.uint64(0xFFFFFFFF)) | np.arange(len(s), dtype=np.uint64)
    width = min(STRETCH, len(s))
    least, done = packed, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    found = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return found[found <= last]


def paragraphs(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """_id, _x, at, n (words), node (hash of the shingles) and, for lines, keys of bands, from _id, _x and _h; stored."""
    width = LENGTH - SHINGLE + 1
    seeds = np.arange(1, bands * rows + 1, dtype=np.uint64) * _ODD[4]
    line_end = _line_end(docs.sparkSession)

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        who, places, nodes, of, starts, words, shingles = [], [], [], [], [], [], []
        for i, h in enumerate(arrays(b.column(2))):
            w, begin, end = _lines(h, line_end)
            if len(w) < LENGTH:
                continue
            s = _shingles(w)
            at = _anchors(s, len(w) - LENGTH)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s))])
            who.append(np.full(len(at), i)), places.append(at), nodes.append(mixed(sums[at + width] - sums[at]))
            if len(begin):
                of.append(np.full(len(begin), i)), starts.append(begin), words.append(end - begin)
                shingles += [s[lo : hi - SHINGLE + 1] for lo, hi in zip(begin.tolist(), end.tolist(), strict=True)]
        names = ["_id", "_x", "at", "n", "node", "keys"]
        if who:
            at, of_doc, node = np.concatenate(places), pa.array(np.concatenate(who)), np.concatenate(nodes)
            columns = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), LENGTH, np.int32)), pa.array(node.view(np.int64)), pa.nulls(len(at), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of_doc), b.column(1).take(of_doc), *columns], names=names)
        if of:
            flat = np.concatenate(shingles)
            heads = np.concatenate([[0], np.cumsum([len(x) for x in shingles])[:-1]])
            node = mixed(np.add.reduceat(mixed(flat), heads) + np.uint64(1))
            keys = np.zeros((len(heads), bands), np.uint64)
            for k, seed in enumerate(seeds):
                keys[:, k // rows] = mixed(keys[:, k // rows] * _ODD[0] + np.minimum.reduceat(mixed(flat ^ seed), heads) + np.uint64(k))
            of_doc = pa.array(np.concatenate(of))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            columns = [pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(words).astype(np.int32)), pa.array(node.view(np.int64)), listed]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of_doc), b.column(1).take(of_doc), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                yield from cut(whole.slice(start, 1024))

    id_type = docs.schema["_id"].dataType.simpleString()
    return stored(docs.mapInArrow(run, f"_id {id_type}, _x bigint, at int, n int, node bigint, keys array<bigint>"), "paragraphs")


def near_lines(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(node, component): lines of different words that are linked, from docs (_id, _x, _t)."""
    keyed = lines.select("node", F.explode("keys").alias("key")).distinct()
    leads = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").drop("last")
    # sums are stored before they are joined back, so that Spark can split hot keys
    candidates = keyed.join(stored(leads, "paragraph-leads"), "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    groups = stored(components(candidates, "paragraph-groups"), "paragraph-group")
    # the words of the lines that are compared, read once more where they first stand
    first = stored(lines.groupBy("node").agg(F.min(F.struct("_id", "_x", "at", "n")).alias("f")), "paragraph-firsts")
    spots = first.join(groups, "node").groupBy(F.col("f._id").alias("_i"), F.col("f._x").alias("_y")).agg(F.collect_list(F.struct("node", "component", F.col("f.at").alias("at"), F.col("f.n").alias("n"))).alias("spots"))
    line_end = _line_end(docs.sparkSession)
    found = docs.dropDuplicates(["_id", "_x"]).join(spots, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_x") == F.col("_y"))).select("spots", marked_hashes(F.col("_t")).alias("_h"))

    def read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, component, grams = [], [], []
            for spots, h in zip(b.column(0).to_pylist(), arrays(b.column(1)), strict=True):
                s = _shingles(h[h != line_end].view(np.uint64))
                for x in spots:
                    node.append(x["node"]), component.append(x["component"])
                    grams.append(np.unique(s[x["at"] : x["at"] + x["n"] - SHINGLE + 1]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(component, pa.int64()), pa.array(node, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], names=["component", "node", "grams"])

    sets = stored(found.mapInArrow(read_out, "component bigint, node bigint, grams array<bigint>"), "paragraph-shingles")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum(F.size("grams")).alias("entries"))
    sizes = stored(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("entries") / ENTRIES)).cast("int")).drop("entries"), "paragraph-sizes")

    def similar(t: dict[str, pa.Array], some: np.ndarray) -> np.ndarray:
        own = list(arrays(t["grams"]))
        size = np.array([len(x) for x in own])
        both = overlaps(own, some)
        return both >= similarity * (size[some][:, None] + size - both) - 1e-9

    rows = sets.join(sizes, "component").withColumn("lead", F.col("component"))
    return components(linked_in_groups(rows, "component", ["grams"], similar, "paragraph-exact"), "paragraph-links")


def _across(found: DataFrame, by: str) -> DataFrame:
    """Values of ``by`` that stand in two documents or more."""
    where = F.hash("_id", "_x").alias("w")  # a document's mark, not its only name: two in 2**32 are taken for one
    return found.select(by, where).groupBy(by).agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo <> hi").select(by)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """id_col, text_hash, unit (line or passage), start and end (words), cluster_id and removed: every occurrence of a paragraph that repeats across documents."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_x"), F.col(text_col).alias("_t"))
    found = paragraphs(texts.select("_id", "_x", marked_hashes(F.col("_t")).alias("_h")), tuned_bands(similarity, recall))
    lines, passages = found.where("keys is not null"), found.where("keys is null").drop("keys")
    links = stored(near_lines(texts, lines, similarity), "paragraph-linked")
    lines = lines.drop("keys").join(links, "node", "left").withColumn("cluster_id", F.coalesce("component", "node")).drop("component")
    lines = stored(lines, "paragraph-lines")
    passages = passages.withColumn("cluster_id", F.col("node"))
    out = None
    for unit, rows in (("line", lines), ("passage", passages)):
        hits = stored(rows.join(stored(_across(rows, "cluster_id"), "paragraph-shared"), "cluster_id", "left_semi"), "paragraph-hits")
        firsts = stored(hits.groupBy("cluster_id").agg(F.min(F.struct("_id", "_x", "at")).alias("first")), "paragraph-kept")
        stays = F.struct("_id", "_x", "at").eqNullSafe(F.col("first"))
        own = hits.join(firsts, "cluster_id").select(F.col("_id").alias(id_col), F.col("_x").alias("text_hash"), F.lit(unit).alias("unit"), F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), "cluster_id", (~stays).alias("removed"))
        out = own if out is None else out.unionByName(own)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of removed paragraphs cut out of the text, and the space after them."""
    cuts = repeated_paragraphs(docs, id_col, text_col).where("removed")
    cuts = cuts.groupBy(F.col(id_col).alias("_i"), F.col("text_hash").alias("_y")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    text = F.col(f"_row.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    lead = F.regexp_extract(text, "^[\\x20\\x09-\\x0D]*", 0)
    gone = F.flatten(F.transform("_cuts", lambda c: F.sequence(c["start"], c["end"] - 1)))

    def rest(p: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(p, i)), "")

    # the row travels as one column, so that none of its names can clash
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    joined = packed.join(cuts, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_y")), "left")
    new = F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(lead, let(pieces, rest)))
    return joined.select(*((new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
