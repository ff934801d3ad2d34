"""Benchmark decontamination by template canonicalisation.

Words become typed placeholders where they are numbers, units of a number, or names
(capitalised words); the rest is lower-cased and stripped of punctuation. Each window has two
keys: that of its template and that of its lower-cased words, so a copy in another case meets
its item too. A document is suspect of an item when it holds most of the item's windows by either
key. It is contaminated when the slots agree too: what fills a placeholder of the item is filled
throughout by one value, so a question asked again with other numbers is caught and a chance
meeting of windows is not. ``verbatim`` says that the fillings are the item's own, case aside.

Defined results: null and empty texts hold no windows; items of fewer words than a window are
too short to identify and match nothing; windows of fewer than ``MIN_LITERALS`` literals say
nothing by their template and do not count, but where they are most of an item's windows all count,
and these by their words; rows of equal id and text are one document; empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import let, read, stored, words

WINDOW = 5
#: What a placeholder starts with; no stripped word does.
SLOT = "\x01"
#: Words in a window that must not be placeholders.
MIN_LITERALS = 2
#: Least share of an item's windows that a document holds, and of its slots that are filled by one value.
SIMILARITY = 0.8
AGREEMENT = 0.8
#: Keys of item windows up to which they are sent to every task; beyond, both sides are dealt by window.
BROADCAST_WINDOWS = 250_000

# Punctuation around words, and units of measure.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&|_~`/\\$+-"
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l s ms min h hr hrs sec secs second seconds minute minutes hour hours "
    "day days week weeks month months year years mph kph kmh km/h m/s percent dollars dollar cents euros euro usd eur "
    "meters metres meter metre kilometers kilometres miles inches feet grams kilograms pounds liters litres degrees"
).split()


def _tokens(text: Column) -> Column:
    return F.filter(F.transform(words(text), lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")


def _slot(kind: str) -> Column:
    return F.xxhash64(F.lit(f"{SLOT}{kind}"))


def _template(tokens: Column, lows: Column, hashes: Column) -> Column:
    """The hash of each word's typed form."""

    def typed(word: Column, i: Column) -> Column:
        first, low = F.substring(word, 1, 1), F.get(lows, i)
        after_number = F.substring(F.get(tokens, i - 1), 1, 1).between("0", "9")
        return (
            F.when(first.between("0", "9"), _slot("number"))
            .when(first != F.substring(low, 1, 1), _slot("name"))
            .when(after_number & low.isin(*UNITS), _slot("unit"))
            .otherwise(F.get(hashes, i))
        )

    return F.transform(tokens, typed)


def _typed(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the hashes of a text's typed words and of its lower-cased words."""

    def of(tokens: Column) -> Column:
        lows = F.transform(tokens, lambda w: F.lower(w))
        return let(lows, lambda low: let(F.transform(low, lambda w: F.xxhash64(w)), lambda h: let(_template(tokens, low, h), lambda k: body(k, h))))

    return let(_tokens(text), of)


def windows(texts: DataFrame, text: Column, keep: list[str], size: int = WINDOW) -> DataFrame:
    """``keep``, keys and lows (hashes of all the text's words as typed and in lower case), and at, key and literal of each window.

    The arrays are those of the whole text: rows must not be shuffled or stored with them. Only the
    words are made by interpreted functions, the windows are made in generated code.
    """
    both = _typed(text, lambda keys, low: F.struct(keys.alias("keys"), low.alias("lows")))
    hashed = texts.select(*keep, both.alias("x")).select(*keep, "x.keys", "x.lows").where(F.size("lows") >= size)
    placed = hashed.select("*", F.explode(F.sequence(F.lit(1), F.size("lows") - (size - 1))).alias("at"))

    def of(column: str, *seed: Column) -> Column:
        return F.xxhash64(*(F.get(column, F.col("at") + (j - 1)) for j in range(size)), *seed)

    return placed.select("*", of("keys").alias("key"), of("lows", F.lit(SLOT)).alias("literal"))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """probe, item, key, item_at, item_slots, kinds and n_windows (distinct keys of the item), stored; a row for each key that finds a window."""
    text = F.col(text_col)
    slot_keys = [_slot(kind) for kind in ("number", "name", "unit")]
    w = windows(benchmark.select(F.col(item_col).alias("item"), text.alias("_text")), F.col("_text"), ["item"])
    kinds = F.array(*(F.get("keys", F.col("at") + (j - 1)).isin(*slot_keys).cast("int") for j in range(WINDOW)))
    w = w.select("item", "key", "literal", F.col("at").alias("item_at"), F.slice("lows", F.col("at"), WINDOW).alias("item_slots"), kinds.alias("kinds"))
    w = w.withColumn("telling", F.aggregate("kinds", F.lit(0), lambda a, y: a + y) <= WINDOW - MIN_LITERALS)
    # windows that do not tell count by their words alone, where they are most of an item
    w = w.withColumn("key", F.when(F.col("telling"), F.col("key")).otherwise(F.col("literal")))
    firsts = w.groupBy("item", "key").agg(F.min_by(F.struct("item_at", "item_slots", "kinds", "literal", "telling"), "item_at").alias("f")).select("item", "key", "f.*")
    sizes = firsts.groupBy("item").agg(F.count(F.when(F.col("telling"), 1)).alias("n_telling"), F.count(F.lit(1)).alias("n_all"))
    all_count = 2 * F.col("n_telling") < F.col("n_all")
    counted = firsts.join(sizes, "item").where(F.col("telling") | all_count).withColumn("n_windows", F.when(all_count, F.col("n_all")).otherwise(F.col("n_telling")))
    probes = F.explode(F.array_distinct(F.array("key", "literal")))
    return stored(counted.select(probes.alias("probe"), "item", "key", "item_at", "item_slots", "kinds", "n_windows"), "benchmark-windows")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, agreement: float = AGREEMENT
) -> DataFrame:
    """A row for each contaminated document and item: id, text_hash, item, n_windows, n_matched, n_slots, n_agreeing, verbatim."""
    items = item_windows(benchmark, item_col)
    n_items = items.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    held = windows(texts, F.col("_text"), ["id", "text_hash"])
    held = held.select("id", "text_hash", "at", "lows", F.explode(F.array("key", "literal")).alias("probe"))
    slots = F.slice("lows", F.col("at"), WINDOW).alias("slots")
    of_item = ["item", "key", "item_at", "item_slots", "kinds", "n_windows"]
    if n_items <= BROADCAST_WINDOWS:
        hits = held.join(F.broadcast(items), "probe").select("id", "text_hash", "at", slots, *of_item)
    else:
        # what is dealt by window holds the window's words only
        hits = held.select("id", "text_hash", "at", slots, "probe").join(items.hint("merge"), "probe").select("id", "text_hash", "at", "slots", *of_item)
    # of an item window's places in a document, the one in line with most others
    hits = hits.withColumn("shift", F.col("at") - F.col("item_at"))
    lines = hits.groupBy("id", "text_hash", "item", "n_windows", "shift").agg(
        F.collect_set(F.struct("key", "item_at", "at", "kinds", "item_slots", "slots")).alias("line")
    )
    ranked = lines.select("id", "text_hash", "item", "n_windows", F.size("line").alias("n"), "shift", F.explode("line").alias("x"))
    best = ranked.groupBy("id", "text_hash", "item", "n_windows", F.col("x.key").alias("key")).agg(F.max_by("x", F.struct("n", -F.col("shift"))).alias("x"))
    matched = best.groupBy("id", "text_hash", "item", "n_windows").agg(F.count(F.lit(1)).alias("n_matched"), F.collect_list("x").alias("xs"))
    suspects = matched.where(F.col("n_matched") >= similarity * F.col("n_windows"))

    def fillings(x: Column) -> Column:
        """(item's word, document's word) at the slots of a window."""
        pairs = F.zip_with(x["item_slots"], x["slots"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(F.zip_with(x["kinds"], pairs, lambda k, p: F.when(k == 1, p)), lambda p: p.isNotNull())

    filled = suspects.withColumn("pairs", F.array_distinct(F.flatten(F.transform("xs", fillings))))
    single = F.filter("pairs", lambda p: F.size(F.filter("pairs", lambda q: q["a"] == p["a"])) == 1)
    checked = filled.select(
        "id", "text_hash", F.col("item").alias(item_col), "n_windows", "n_matched", F.size("pairs").alias("n_slots"), F.size(single).alias("n_agreeing"), F.forall("pairs", lambda p: p["a"] == p["b"]).alias("verbatim")
    )
    return checked.where(F.col("n_agreeing") >= agreement * F.col("n_slots"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contaminated(docs, benchmark, id_col, text_col, item_col).select("id", "text_hash").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["text_hash"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("text_hash")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_UNIT_LIST = ", ".join(map(_sql, UNITS))
OP2_SQL = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tok AS (SELECT side, id, text, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: trim(w, {_sql(PUNCTUATION)})), lambda w: w <> '') AS ws FROM src),
word AS (SELECT side, id, text, len(ws) AS n, i, ws[i] AS raw, CASE WHEN left(ws[i], 1) BETWEEN '0' AND '9' THEN chr(1) || 'number' WHEN left(ws[i], 1) <> left(lower(ws[i]), 1) THEN chr(1) || 'name'
  WHEN lower(ws[i]) IN ({_UNIT_LIST}) AND i > 1 AND left(ws[i - 1], 1) BETWEEN '0' AND '9' THEN chr(1) || 'unit' ELSE lower(ws[i]) END AS typed FROM tok, unnest(range(1, len(ws) + 1)) AS r(i)),
win AS (SELECT side, id, text, i AS pos, list(typed) OVER w AS key, list(lower(raw)) OVER w AS slots, n FROM word WINDOW w AS (PARTITION BY side, id, text ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
full_win AS (SELECT *, len(list_filter(key, lambda k: left(k, 1) = chr(1))) <= {WINDOW - MIN_LITERALS} AS telling FROM win WHERE pos <= n - {WINDOW - 1}),
told AS (SELECT id AS item_id, telling, CASE WHEN telling THEN key ELSE slots END AS key, key AS typed, pos, slots FROM full_win WHERE side = 'i'),
item AS (SELECT item_id, telling, key, min(pos) AS item_at, arg_min(slots, pos) AS item_slots, arg_min(typed, pos) AS typed FROM told GROUP BY ALL),
tally AS (SELECT item_id, count(*) FILTER (telling) AS n_telling, count(*) AS n_all FROM item GROUP BY item_id),
sized AS (SELECT item.*, CASE WHEN 2 * n_telling < n_all THEN n_all ELSE n_telling END AS n_windows FROM item JOIN tally USING (item_id) WHERE telling OR 2 * n_telling < n_all),
hit AS (SELECT d.id AS doc_id, d.text, item_id, n_windows, sized.key, typed, item_at, item_slots, d.pos, d.slots, d.pos - item_at AS shift FROM full_win d JOIN sized ON d.key = sized.key WHERE d.side = 'd'
  UNION SELECT d.id AS doc_id, d.text, item_id, n_windows, sized.key, typed, item_at, item_slots, d.pos, d.slots, d.pos - item_at AS shift FROM full_win d JOIN sized ON d.slots = sized.item_slots WHERE d.side = 'd'),
ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text, item_id, shift) AS c FROM hit),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id, key ORDER BY c DESC, shift) = 1),
suspect AS (SELECT doc_id, text, item_id, n_windows, count(*) AS n_matched FROM best GROUP BY ALL HAVING count(*) >= {SIMILARITY} * n_windows),
pair AS (SELECT DISTINCT doc_id, text, item_id, item_slots[k] AS a, slots[k] AS b FROM best, range(1, {WINDOW + 1}) AS r(k) WHERE left(typed[k], 1) = chr(1)),
judged AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text, item_id, a) = 1 AS single FROM pair),
slot AS (SELECT doc_id, text, item_id, count(*) AS n_slots, count(*) FILTER (single) AS n_agreeing, bool_and(a = b) AS verbatim FROM judged GROUP BY ALL)
SELECT s.doc_id, s.item_id, s.n_windows, s.n_matched, coalesce(n_slots, 0)::INT AS n_slots, coalesce(n_agreeing, 0)::INT AS n_agreeing, coalesce(verbatim, true) AS verbatim
FROM suspect s LEFT JOIN slot p ON s.doc_id = p.doc_id AND s.text = p.text AND s.item_id = p.item_id WHERE coalesce(n_agreeing, 0) >= {AGREEMENT} * coalesce(n_slots, 0)
"""
