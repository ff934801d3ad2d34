"""N-gram Jaccard self-join as a blocked sparse product of documents by n-grams.

A document is the set of its n-gram hashes; equal sets are one node. The product of the incidence
matrix with its transpose is formed by blocks, and only where it can matter: each node keeps a prefix of its
n-grams, rarest first, long enough that two linked nodes must share one (size-derived bound); nodes
that share one meet, and pairs beyond the bounds on sizes and on the symmetric difference (a parity
sketch never overstates it) are discarded. What is left connects candidate groups. In a block, overlap
counts are accumulated over the columns that two rows or more have, and links are read off exactly.

A group of any size is dealt to blocks of ``BLOCK`` rows, its least node to each of them. Most rows are linked
with that one there and then; only the others meet the rest of the group, block by block. A link between nodes
already connected need not be found, so a block returns a spanning forest; its components are those of all links.

Defined results: no words (null, empty) means an empty set and no links, the document is its own
component; fewer words than n are one n-gram; documents of equal sets are linked; rows of equal
id stand for one document; a null id is alone unless linked, and least ids ignore it; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_RUN, read, stored
from plumbline.llm.graph import components

N = 4
PERCENT = 85
#: Counters of the frequency sketch (2**SKETCH_BITS), its slices, and least and most bits of a parity sketch.
SKETCH_BITS = 20
SLICES = 64
PARITY_BITS = 512
MOST_PARITY_BITS = 1 << 15
#: Nodes that share an n-gram up to which they are paired at once, and nodes in a block of the product.
FEW = 64
BLOCK = 512
#: N-grams in a block at which a group is dealt to more of them.
ENTRIES = 1 << 21
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096

_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they stand."""
    t = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, upper, lower))


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(lowered(text), SPACE_RUN), ""), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[4]
    return x ^ (x >> np.uint64(29))


def ngrams(h: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of word hashes; the whole sequence if shorter."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    width = min(n, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total += h[i : len(h) - width + 1 + i] * _ODD[i % 8] + np.uint64(i)
    return np.unique(mixed(total + np.uint64(width)))


def fingerprint(s: np.ndarray) -> int:
    """One number for a set."""
    sums = np.array([s.sum(), mixed(s).sum(), len(s)], np.uint64) * _ODD[:3]
    return int(mixed(sums.sum(keepdims=True)).view(np.int64)[0])


def parity(s: np.ndarray) -> np.ndarray:
    """Which of at least as many bits as elements an odd number of elements fall on, as 64-bit words."""
    bits = PARITY_BITS
    while bits < min(len(s), MOST_PARITY_BITS):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(p: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch (or rows of them) of fewer words."""
    while p.shape[-1] > words:
        half = p.shape[-1] // 2
        p = p[..., :half] ^ p[..., half:]
    return p


def least_difference(p: np.ndarray, q: np.ndarray) -> int:
    """Elements in which two sets differ at least."""
    words = min(len(p), len(q))
    return int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum())


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as numpy arrays."""
    values, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    base = offsets[0]
    for a, b in zip(offsets[:-1] - base, offsets[1:] - base, strict=True):
        yield values[a:b]


def allowed_difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference at which sets of these sizes are still linked."""
    return ((100 - percent) * (a + b)) // (100 + percent)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """A level for each counter of the sketch: 0 up to the mean count, then powers of two.

    Exact sums over all documents; 2**SKETCH_BITS bytes whatever the input.
    """
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            grams = [ngrams(h.view(np.uint64), n) for h in arrays(b.column(0))]
            if grams:
                counts += np.bincount((np.concatenate(grams) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": [counts[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.int64)
                sums[at] = sums[at] + x if at in sums else x.copy()
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": [x.tobytes() for x in sums.values()]})

    schema = "slice int, counts binary"
    parts = docs.select("_h").mapInArrow(count, schema)
    # sums meet in two steps, so that no task reads all partial counts
    some = parts.repartition(16, "slice", F.spark_partition_id() % 16).mapInArrow(add, schema)
    whole = some.repartition(8, "slice").mapInArrow(add, schema)
    table = {r["slice"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in whole.collect()}  # SLICES rows
    counts = np.concatenate([table.get(i, np.zeros(width, np.int64)) for i in range(SLICES)])
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / max(counts.mean(), 1.0)))).astype(np.uint8)


def sketch(docs: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """_id, n_shingles, node (set fingerprint), parity and prefix of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64)
        for b in batches:
            sizes, nodes, parities, prefixes = [], [], [], []
            for h in arrays(b.column(1)):
                s = ngrams(h.view(np.uint64), n)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), parities.append(b""), prefixes.append(np.zeros(0, np.int64))
                    continue
                nodes.append(fingerprint(s))
                parities.append(parity(s).tobytes())
                keep = len(s) - -(-percent * len(s) // 100) + 1
                rank = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6))
                first = np.argpartition(rank, keep - 1)[:keep] if keep < len(s) else np.arange(len(s))
                prefixes.append(s[first].view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {"_id": b.column(0), "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64()), "parity": pa.array(parities, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}
            )

    id_type = docs.schema["_id"].dataType.simpleString()
    return stored(docs.mapInArrow(run, f"_id {id_type}, n_shingles bigint, node bigint, parity binary, prefix array<bigint>"), "ngram-sets")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys (the first ``keys`` columns), from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(i)) for i in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and any(np.asarray(held[-1].column(i))[-1] != columns[i][0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, b.slice(0, change[-1])])
            held = [b.slice(change[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def edges_of(n: np.ndarray) -> np.ndarray:
    """Starts of runs in a sorted array, and its length."""
    return np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)]])


def sketches_apart(sizes: np.ndarray, parities: list[np.ndarray], rows: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of the first ``rows`` rows with all rows are within the bounds on sizes and differences."""
    ok = np.zeros((len(rows), len(sizes)), bool)
    lengths = np.array([len(p) for p in parities])
    # rows by sketch length; of linked sizes lengths differ by a factor of two at most
    at_length = {w: np.stack([folded(p, w) for p in parities if len(p) >= w]) for w in np.unique(lengths)}
    row_of = {w: np.cumsum(lengths >= w) - 1 for w in at_length}
    for k, i in enumerate(rows.tolist()):
        near = np.flatnonzero(100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        for w in np.unique(np.minimum(lengths[near], lengths[i])):
            some = near[np.minimum(lengths[near], lengths[i]) == w]
            far = np.bitwise_count(at_length[w][row_of[w][some]] ^ at_length[w][row_of[w][i]]).sum(axis=1)
            ok[k, some] = far <= allowed_difference(sizes[some], sizes[i], percent)
    return ok


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Elements that sets share, ``rows`` by all: incidence times its transpose, ``COLUMNS`` shared elements at a time."""
    lengths = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # what one row has adds to no overlap
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(rows), len(sets)), np.int64)
    whole = len(rows) == len(sets)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[row[lo:hi], column[lo:hi] - start] = 1
        total += ((incidence if whole else incidence[rows]) @ incidence.T).astype(np.int64)
    return total


def forest_edges(linked: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """A spanning forest of a block of links, ``rows`` by all, and a label of each row's tree."""
    label, a, b = np.arange(linked.shape[1]), [], []
    for k, i in enumerate(rows.tolist()):
        near = np.flatnonzero(linked[k])
        trees, first = np.unique(label[near], return_index=True)
        for tree, j in zip(trees.tolist(), near[first].tolist(), strict=True):
            if tree != label[i]:
                a.append(i), b.append(j)
                label[label == tree] = label[i]
    return a, b, label


def linked_in_groups(rows: DataFrame, key: str, columns: list[str], link: Callable[[dict[str, pa.Array], np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(a, b): a spanning forest of the links within each group of ``rows`` (key, node, lead, count, blocks, columns), stored.

    ``link`` takes the columns of a block (and node) and the places of some of its rows, and says which of all rows they are
    linked with. ``lead`` is a node of the group, ``count`` its number of rows and ``blocks`` into how many it is dealt. Rows that
    are linked with the lead in their block are done; if there are more blocks, others meet all of them: rows dealt grow
    with the group and with those left over.
    """
    hashed, blocks = F.xxhash64("node"), F.col("blocks")
    own = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(hashed, blocks).cast("int")))
    first = rows.select(key, F.explode(own).alias("block"), "node", "lead", "blocks", *columns)

    def compare(t: pa.Table, lo: int, hi: int, some: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
        part = t.slice(lo, hi - lo)
        return forest_edges(link({c: part.column(c).combine_chunks() for c in ("node", *columns)}, some), some)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            keyed, block, node, lead, n_blocks = (np.asarray(t.column(i)) for i in range(5))
            a, b, group, left = [], [], [], []
            for lo, hi in groups_of(keyed, block):
                x, y, tree = compare(t, lo, hi, np.arange(hi - lo))
                a += node[lo + np.array(x, int)].tolist()
                b += node[lo + np.array(y, int)].tolist()
                if n_blocks[lo] > 1:
                    rest = np.flatnonzero(tree != tree[np.argmax(node[lo:hi] == lead[lo])])
                    group += [keyed[lo].item()] * len(rest)
                    left += node[lo + rest].tolist()
            edges = pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["group", "a", "b"])
            yield edges
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(left, pa.int64()), pa.nulls(len(left), pa.int64())], names=["group", "a", "b"])

    dealt = first.repartition(key, "block").sortWithinPartitions(key, "block")
    found = stored(dealt.mapInArrow(meet, "group bigint, a bigint, b bigint"), name)
    edges = found.where("group is null").select("a", "b")
    left = found.where("group is not null").select(F.col("group").alias(key), F.col("a").alias("node"))
    counts = stored(left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left")), f"{name}-left")
    if counts.isEmpty():
        return edges
    # what is left over, in blocks (side 0), with all blocks of its group (side 1)
    again = rows.join(counts, key).withColumn("own", F.pmod(hashed, blocks).cast("int"))
    left_blocks = F.ceil(F.col("n_left") * blocks / F.col("count")).cast("int")
    every = again.withColumn("part", F.explode(F.sequence(F.lit(0), left_blocks - 1))).withColumn("side", F.lit(1))
    some = again.join(left, [key, "node"], "left_semi").withColumn("part", F.pmod(hashed, left_blocks).cast("int"))
    some = some.drop("own").withColumn("own", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    both = some.select(key, "part", "own", "side", "node", *columns).unionByName(every.select(key, "part", "own", "side", "node", *columns))

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            keyed, part, own, side, node = (np.asarray(t.column(i)) for i in range(5))
            a, b = [], []
            for lo, hi in groups_of(keyed, part, own):
                x, y, _ = compare(t, lo, hi, np.flatnonzero(side[lo:hi] == 0))
                a += node[lo + np.array(x, int)].tolist()
                b += node[lo + np.array(y, int)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = both.repartition(key, "part", "own").sortWithinPartitions(key, "part", "own", "side")
    return edges.unionByName(stored(dealt.mapInArrow(meet_again, "a bigint, b bigint").where("a <> b").distinct(), f"{name}-again"))


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all nodes which may be linked."""
    # one row a distinct set; copies add nothing
    first = sets.where("node is not null").groupBy("node").agg(F.min("_id").alias("_id"))
    first = stored(first.select(F.col("node").alias("_n"), F.col("_id").alias("_f")), "ngram-first")
    same = (F.col("node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_f"))
    nodes = stored(sets.join(first, same, "left_semi").select("node", "n_shingles", "parity", "prefix"), "ngram-nodes")
    tokens = nodes.select(F.explode("prefix").alias("token"), "node", F.col("n_shingles").cast("int").alias("size"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("lead")).where("count > 1")
    # stored, as are other sums that are joined back: the join then reads two plain exchanges, whose hot keys Spark can split
    shared = stored(shared, "ngram-shared")
    meeting = stored(tokens.join(shared, "token"), "ngram-meetings")
    sketches = nodes.select("node", "n_shingles", "parity")

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for t in runs(batches, 1):
            token, node, size = (np.asarray(t.column(i)) for i in range(3))
            bounds = edges_of(token)
            count = np.diff(bounds)
            # the k-th row of each group with the j-th, for all groups of enough rows at once
            for k in range(int(count.max()) - 1):
                first = bounds[:-1][count > k + 1] + k
                for j in range(1, int(count.max()) - k):
                    first = first[count[np.searchsorted(bounds, first, "right") - 1] > k + j] if j > 1 else first
                    a, b = first, first + j
                    ok = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
                    held.append(np.stack([np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])], axis=1))
            if sum(map(len, held)) > 2_000_000:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], names=["a", "b"])
                    held = []
        if held:
            pairs = np.unique(np.concatenate(held), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    few = meeting.where(F.col("count") <= FEW).select("token", "node", "size").repartition("token").sortWithinPartitions("token")
    pairs = few.mapInArrow(pair_up, "a bigint, b bigint").distinct()
    left = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("parity").alias("p_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("parity").alias("p_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = allowed_difference(np.asarray(b.column("n_a")), np.asarray(b.column("n_b")), percent).tolist()
            ok = [
                least_difference(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) <= m
                for p, q, m in zip(b.column("p_a"), b.column("p_b"), most, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    close = pairs.join(left, "a").join(right, "b").mapInArrow(near, "a bigint, b bigint")

    # n-grams of many nodes: in blocks, where a forest of the near pairs says as much as all of them
    rows = meeting.where(F.col("count") > FEW).select("token", "node", "lead", "count", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")).join(sketches, "node")

    def within_bounds(t: dict[str, pa.Array], some: np.ndarray) -> np.ndarray:
        return sketches_apart(np.asarray(t["n_shingles"]), [np.frombuffer(p, np.uint64) for p in t["parity"].to_pylist()], some, percent)

    return close.unionByName(linked_in_groups(rows, "token", ["n_shingles", "parity"], within_bounds, "ngram-near"))


def groups_of(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys that have two rows or more."""
    change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            yield lo, hi


def exact_edges(texts: DataFrame, sets: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the exact links in each candidate group (node, component), from texts (_id, _t)."""
    # one row a node; blocks are bounded in rows and in n-grams
    whole = sets.where("node is not null").groupBy("node").agg(F.min("_id").alias("_id"), F.first("n_shingles").alias("size")).join(groups, "node")
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("entries"))
    sizes = stored(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("entries") / ENTRIES)).cast("int")).drop("entries"), "ngram-group-sizes")
    who = whole.join(sizes, "component")
    holders = texts.join(who.select(F.col("_id").alias("_w"), "node", "component", "count", "blocks"), F.col("_id").eqNullSafe(F.col("_w")))
    # an id that stands for several texts brings them all; a node's own is the one that counts. Texts travel, being smaller than their hashes
    rows = stored(holders.select("component", "node", F.col("component").alias("lead"), "count", "blocks", F.col("_t").alias("text")), "ngram-texts")

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [ngrams(h.view(np.uint64), n) for h in arrays(b.column(5))]
            own = [len(g) > 0 and fingerprint(g) == v for g, v in zip(grams, b.column(1).to_pylist(), strict=True)]
            kept = b.filter(pa.array(own, pa.bool_()))
            ids = pa.array([g.view(np.int64) for g, ok in zip(grams, own, strict=True) if ok], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(5)), ids], names=["component", "node", "lead", "count", "blocks", "grams"])

    hashed = rows.select("component", "node", "lead", "count", "blocks", word_hashes(F.col("text")).alias("_h"))
    incidence = hashed.mapInArrow(matching, "component bigint, node bigint, lead bigint, count bigint, blocks int, grams array<bigint>")

    def similar(t: dict[str, pa.Array], some: np.ndarray) -> np.ndarray:
        own = list(arrays(t["grams"]))
        size = np.array([len(x) for x in own])
        both = overlaps(own, some)
        return 100 * both >= percent * (size[some][:, None] + size - both)

    return linked_in_groups(incidence, "component", ["grams"], similar, "ngram-exact")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, node (equal for equal sets) and component_id of every row of ``docs``."""
    if not math.isclose(percent, int(percent)) or not 50 < percent <= 100:
        raise ValueError("percent is a whole number over 50 and up to 100")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    hashed = texts.select("_id", word_hashes(F.col("_t")).alias("_h"))
    sets = sketch(hashed, frequency_levels(hashed, n), n, percent)
    groups = stored(components(candidate_edges(sets, percent), "ngram-groups"), "ngram-candidates")
    links = components(exact_edges(texts, sets, groups, n, percent), "ngram-links")
    marked = sets.select("_id", "n_shingles", "node").join(links, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    # an empty set is a component of its own
    lone = marked.where("_c is null").select("_id", "n_shingles", "node", F.col("_id").alias("component_id"))
    least = stored(marked.where("_c is not null").groupBy("_c").agg(F.min("_id").alias("component_id")), "ngram-least")
    linked = marked.where("_c is not null").join(least, "_c").select("_id", "n_shingles", "node", "component_id")
    return linked.unionByName(lone).withColumnRenamed("_id", id_col)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
