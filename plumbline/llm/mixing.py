"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets are shares of the mix by source weight, capped at a multiple of the source. A source's
documents fall into blocks by a hash; its target is a number of full passes over the blocks
and a last pass that stops at the exact word. A binary tree splits the block quotas of all
sources among the output shards: each node draws how many blocks of each source go left, as
drawing from an urn without return, so every shard gets an equal number of blocks and every
source its exact quota. Shards then take disjoint stretches of each source's permuted blocks
and order what they got by a hash of their own.

Defined results: a null text has size 0; a null source is a source, last in order; a source
without words has target 0; a document without words comes along with its block; rows that repeat are documents of their own; an empty table gives
an empty result. All draws are hashes of ids and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, read, stored, words

#: Weights in turn over the sources by code point order, nulls last.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of all sources; a target's cap over its source.
SHARE = 1.5
REPEATS = 2
#: Words in a block, and blocks of a source at most: beyond, blocks are larger.
BLOCK_WORDS = 8_192
MAX_BLOCKS = 1_024
#: Levels of the splitting tree: 2**LEVELS output shards.
LEVELS = 3


def targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with rank and target; one row a source throughout.

    With sources in order of cap over weight, those before the first whose cap is not
    below the level are capped; the level is what is left over the weights left.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") - 1) % len(weights) + 1)
    cap = F.col("source_size") * float(repeats)
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", w)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    )
    target = F.least(cap, F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight"))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """From (rank, quota) to (rank, ends): blocks of the source that shards 0..i take in all.

    Holds a number for each source and node; no documents or blocks.
    """

    def split(node: Column, name: Column) -> Column:
        """The node's quotas that go left, source by source, drawn from one urn."""
        total = F.aggregate(node, F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("n"), F.floor((total + 1) / 2).alias("left"), F.array().cast("array<bigint>").alias("out"))

        def source(acc: Column, q: Column) -> Column:
            def draw(s: Column, i: Column) -> Column:
                goes = _uniform(F.lit(seed), name, F.size(acc["out"]), i) * s["n"] < s["left"]
                step = F.when(goes, F.lit(1)).otherwise(F.lit(0)).cast("long")
                return F.struct((s["n"] - 1).alias("n"), (s["left"] - step).alias("left"), (s["got"] + step).alias("got"))

            urn = F.struct(acc["n"].alias("n"), acc["left"].alias("left"), F.lit(0).cast("long").alias("got"))
            drawn = F.when(q > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(q, F.lit(1))), urn, draw)).otherwise(urn)
            return let(drawn, lambda d: F.struct(d["n"].alias("n"), d["left"].alias("left"), F.concat(acc["out"], F.array(d["got"])).alias("out")))

        return F.aggregate(node, start, source, lambda a: a["out"])

    row = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("quota")))).alias("s"))
    row = row.select(F.col("s.rank").alias("ranks"), F.array(F.col("s.quota")).alias("nodes"))

    def halves(level: int):
        return lambda node, at: let(split(node, F.lit(1 << level) + at), lambda left: F.array(left, F.zip_with(node, left, lambda q, x: q - x)))

    for level in range(levels):
        row = row.select("ranks", F.flatten(F.transform("nodes", halves(level))).alias("nodes"))
    shards = row.select(F.col("nodes"), F.posexplode("ranks").alias("at", "rank"))
    mine = F.transform("nodes", lambda node: F.element_at(node, F.col("at") + 1))
    ends = F.transform(mine, lambda x, i: F.aggregate(F.slice(mine, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    return shards.select("rank", ends.alias("ends"))


def plan(sizes: DataFrame, levels: int = LEVELS, seed: int = 0, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) for ``sizes`` (source, size, place): a row a source, a row a block that is drawn.

    ``place`` is a hash of the document. A block has ``times`` whole takes, the ``cut`` words
    of its last take where that is not whole, and the shards of its takes in order.
    """
    sources = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), share, repeats, weights), "mix-sources")
    goal = F.round("target").cast("long")
    sources = sources.select(
        "*",
        F.least(F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("long").alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
        goal.alias("goal"),
    ).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    held = in_blocks(sizes, sources).groupBy("rank", "block").agg(F.sum("size").alias("words"))
    # a row of each block and pass, in the order of the pass; at most MAX_BLOCKS rows a source and pass
    drawn = held.join(sources.select("rank", "passes", "rest"), "rank").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    mixed = F.xxhash64(F.lit(seed), F.col("rank"), F.col("pass"), F.col("block"))
    by_pass = Window.partitionBy("rank", "pass").orderBy(mixed, "block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum("words").over(by_pass), F.lit(0)))
    last = F.col("pass") == F.col("passes")
    room = F.when(last, F.col("rest") - F.col("before")).otherwise(F.col("words"))
    drawn = drawn.withColumn("take", F.least(room, F.col("words"))).where((F.col("take") > 0))
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("rank").orderBy("pass", "before", mixed, "block")) - 1)
    drawn = stored(drawn.select("rank", "block", "pass", "words", "take", "at"), "mix-draws")
    ends = splitting_tree(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), levels, seed)
    dealt = drawn.join(ends, "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    whole = F.col("take") == F.col("words")
    blocks = dealt.groupBy("rank", "block").agg(
        F.sum(whole.cast("long")).alias("times"),
        F.sum(F.when(~whole, F.col("take")).otherwise(0)).alias("cut"),
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"),
    )
    return sources, blocks


def in_blocks(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with its source's rank and its block."""
    s = sources.select(F.col("source").alias("_s"), "rank", "n_blocks", "source_size", "target")
    joined = sizes.join(s, sizes["source"].eqNullSafe(s["_s"])).drop("_s")
    return joined.withColumn("block", F.pmod("place", F.col("n_blocks")))


def mix(
    sizes: DataFrame, levels: int = LEVELS, seed: int = 0, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, rows: DataFrame | None = None
) -> DataFrame:
    """``sizes`` (source, size, place, ...) with source_size, target, taken and shards.

    ``shards`` holds the shard of each take, in order; the last may be a part of the document
    where the source's target ends in it. Within a shard, takes are ordered by ``local_order``.
    With ``rows``, the mix is planned on ``sizes`` and dealt to ``rows``: the same rows, with more columns.
    """
    sources, blocks = plan(sizes, levels, seed, share, repeats, weights)
    blocks = stored(blocks, "mix-blocks")
    sizes = sizes if rows is None else rows
    placed = in_blocks(sizes, sources)
    dealt = placed.join(blocks, ["rank", "block"], "left")
    uncut = F.coalesce("cut", F.lit(0)) == 0
    # one block a source ends within; only its documents need a running sum
    inside = Window.partitionBy("rank", "block").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.where(~uncut).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = F.greatest(F.least(F.col("cut") - F.col("_before"), F.col("size")), F.lit(0))
    taken_part = F.col("times") * F.col("size") + last
    none = F.array().cast("array<int>")
    keep = [F.col(c) for c in sizes.columns] + [F.col("source_size"), F.col("target")]
    return dealt.where(uncut).select(*keep, (F.coalesce("times", F.lit(0)) * F.col("size")).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards")).unionByName(
        part.select(*keep, taken_part.cast("long").alias("taken"), F.when(last > 0, F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("times").cast("int"))).alias("shards"))
    )


def local_order(seed: int, shard: Column, place: Column, take: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("order"), shard, place, take)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """id, source, size in words and place, stored: all that planning needs of the documents."""
    return stored(measured(docs, id_col, text_col, seed).select(F.col(id_col), F.col(source_col).alias("source"), "size", "place"), "mix-sizes")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with size in words and place, in the place of columns of these names."""
    return docs.withColumns({"size": F.size(words(F.col(text_col))).cast("long"), "place": F.xxhash64(F.lit(seed), F.col(id_col))})


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """A row for each take: the columns of ``docs``, take, shard, local_order and words; a part take has its first words as text."""
    # the row travels as one column, so that none of its names can clash; those of the result replace it
    whole = docs.withColumn("__doc", F.struct(*(docs[c] for c in docs.columns)))
    packed = measured(whole, id_col, text_col, seed).select("source", "size", "place", F.col("__doc").alias("doc"))
    dealt = mix(sized(docs, id_col, text_col, seed=seed), levels, seed, rows=packed)
    takes = dealt.select("doc", "size", "place", "taken", F.posexplode("shards").alias("take", "shard"))
    takes = takes.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("take") * F.col("size")))
    text = F.col(f"doc.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    new = F.when(F.col("words") < F.col("size"), part).otherwise(text)
    return takes.select(
        *((new if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c not in ("take", "shard", "local_order", "words")), "take", "shard", local_order(seed, F.col("shard"), F.col("place"), F.col("take")).alias("local_order"), "words"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken", "shards")
