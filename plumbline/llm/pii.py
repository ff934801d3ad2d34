"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Base spans are emails, IPv4 addresses, payment cards and phone numbers. Each distinct value
is a protected entity. A term of the same document discloses it as far as seeing the term tells
the entity: pointwise mutual information over the entity's information content, both from
document counts over the whole corpus. Terms at or above the threshold, with enough distinct
texts behind the estimate, are spans wherever they stand in any text. Letters in a
base span are no terms. Sanitising generalises base spans to their kind and removes
disclosing terms.

Defined results: a null or empty text has no spans; a null id is an id like another; rows of
equal id and text get equal spans; copies of a text count as documents but as one witness of
a co-occurrence; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import let, read, stored

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, anchored and made possessive where that cannot change a match:
# a long run of pattern characters is scanned once instead of once for each start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"
NOT_TERM = r"[^\p{L}]+"

#: Least share of an entity's information content that a term must tell, and distinct texts that show it.
DISCLOSURE = 0.8
MIN_TEXTS = 3
#: Most disclosing terms that are broadcast; more are joined as Spark plans it.
BROADCAST_TERMS = 200_000

SPAN = "struct<start:int,end:int,value:string>"


def _laid_out(pairs: Column, kind: str, found: Callable[[Column, Column, Column], Column]) -> Column:
    """Offsets of matches from pairs (value, gap): ``found(pair, start, end)`` is an array of what each gives, concatenated.

    A fold that appends copies its array at every step, so pairs are folded in stretches of the root of their number, each from
    its own offset: n matches take the power 1.5 of n steps, not the square.
    """
    width = lambda x: F.length(x["gap"]) + F.length(x["value"])
    none = F.array().cast(f"array<{kind}>")

    def stretch(part: Column, offset: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(acc["out"], found(x, start, end)).alias("out"))

        return F.aggregate(part, F.struct(offset.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def all_of(p: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(p))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: F.slice(p, i * size + 1, size))

        def placed(parts: Column) -> Column:
            sums = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + width(x)))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            offsets = F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(parts, offsets, stretch))

        return F.when(F.size(p) == 0, none).otherwise(let(parts, placed))

    return let(pairs, all_of)


def _pairs(text: Column, pattern: str) -> Column:
    """The matches of a pattern, each with what stands between it and the one before."""
    gaps = let(F.split(text, pattern, -1), lambda g: F.slice(g, 1, F.size(g) - 1))
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("value"), g.alias("gap")))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code point offsets, end exclusive."""
    return _laid_out(_pairs(text, pattern), SPAN, lambda x, start, end: F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def points(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, points), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """A struct of the spans of each kind that pass its check."""
    none = F.array().cast(f"array<{SPAN}>")

    def ip_ok(s: Column) -> Column:
        return F.forall(F.split(s["value"], "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))

    def card_ok(s: Column) -> Column:
        return let(_digits(s["value"]), lambda d: F.length(d).between(13, 19) & _luhn(d))

    def phone_ok(s: Column) -> Column:
        return F.length(_digits(s["value"])).between(9, 15)

    return F.struct(
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none).alias("email"),
        F.when(text.rlike(IP), F.filter(spans(text, IP), ip_ok)).otherwise(none).alias("ip"),
        F.when(text.rlike(CARD), F.filter(spans(text, CARD), card_ok)).otherwise(none).alias("card"),
        F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), phone_ok)).otherwise(none).alias("phone"),
    )


def _taken(base: Column) -> Column:
    return F.concat(*(base[k] for k in KINDS))


def _blanked(text: Column) -> Column:
    """The text with its emails as so many spaces; the other kinds hold no letters, so that they hide no term."""
    blanks = F.transform(F.concat(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.array(F.lit(""))), lambda m: F.repeat(F.lit(" "), F.length(m)))
    plain = F.array_join(F.zip_with(F.split(text, EMAIL, -1), blanks, lambda gap, blank: F.concat(gap, blank)), "")
    return F.when(F.contains(text, F.lit("@")), plain).otherwise(text)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), NOT_TERM)), lambda t: F.length(t) >= 3)


def _entities(base: Column) -> Column:
    def of(kind: str) -> Column:
        def value(s: Column) -> Column:
            return F.lower(s["value"]) if kind == "email" else s["value"] if kind == "ip" else _digits(s["value"])

        return F.transform(base[kind], lambda s: F.concat(F.lit(f"{kind}:"), value(s)))

    return F.array_distinct(F.concat(*(of(k) for k in KINDS)))


def _places(text: Column, told: Column) -> Column:
    """Spans of the terms of the text that are told."""
    kind = "struct<start:int,end:int>"
    found = lambda x, start, end: F.when(F.array_contains(told, F.lower(x["value"])), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(f"array<{kind}>"))
    return _laid_out(_pairs(text, TERM), kind, found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row a document: _id, _text (hash), base spans and, if there are any, entities and terms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_t"), let(text, base_spans).alias("base"))
    some = F.size(_taken(F.col("base"))) > 0
    terms = F.when(some, _terms(_blanked(F.col("_t"))))
    return stored(found.select("_id", "_text", "base", F.when(some, _entities(F.col("base"))).alias("entities"), terms.alias("terms")), "pii-spans")


def telling_terms(docs: DataFrame, found: DataFrame, text_col: str, disclosure: float, min_texts: int) -> DataFrame:
    """Terms that disclose an entity, stored."""
    plain = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: _terms(_blanked(t)))
    counts = docs.select(F.explode(plain).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # copies of a text have equal entities and terms
    texts = found.where("entities is not null").dropDuplicates(["_id", "_text"])
    texts = texts.groupBy("_text").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = stored(texts, "pii-texts")
    entities = texts.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    # a pair has no more texts than its entity
    entities = stored(entities.where(F.col("texts") >= min_texts).drop("texts"), "pii-entities")
    seen = texts.select(F.explode("entities").alias("entity"), "copies", "terms").join(entities.select("entity"), "entity")
    both = seen.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_both"))
    both = stored(both.where(F.col("texts") >= min_texts), "pii-pairs")
    n = float(docs.count())
    pairs = both.join(entities, "entity").join(stored(counts, "pii-terms"), "term")
    information = F.log2(F.lit(n) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.col("n_term")))
    return stored(pairs.where((information > 0) & (pmi >= disclosure * information)).select("term").distinct(), "pii-telling")


def term_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """_id, _text and the sorted spans of disclosing terms, for documents that have any."""
    telling = telling_terms(docs, found, text_col, disclosure, min_texts)
    if telling.count() <= BROADCAST_TERMS:
        telling = F.broadcast(telling)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_t"))
    told = own.select("_id", "_text", F.explode(_terms(F.col("_t"))).alias("term")).join(telling, "term")
    told = stored(told.groupBy(F.col("_id").alias("_i"), F.col("_text").alias("_x")).agg(F.collect_set("term").alias("told")), "pii-told")
    # those told grow with the corpus, so they are merged at every size; texts are left behind before rows of equal id and text, whose spans are equal, become one
    spans = own.join(told.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")))
    places = spans.select("_id", "_text", let(_blanked(F.col("_t")), lambda t: _places(t, F.col("told"))).alias("terms"))
    return stored(places.where(F.size("terms") > 0).dropDuplicates(["_id", "_text"]), "pii-places")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``id_col``, base (struct of spans by kind) and terms (spans), one row for each row of ``docs``."""
    found = find(docs, id_col, text_col)
    terms = term_spans(docs, found, id_col, text_col, disclosure, min_texts)
    joined = found.drop("terms").join(terms.withColumnsRenamed({"_id": "_i", "_text": "_x"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")), "left")
    return joined.select(F.col("_id").alias(id_col), "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with base spans of the text generalised to ``[kind]`` and disclosing terms removed."""
    found = find(docs, id_col, text_col)

    def edit(kind: str) -> Column:
        return F.transform(F.col(f"base.{kind}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("by")))

    base = found.where(F.col("entities").isNotNull()).dropDuplicates(["_id", "_text"])  # rows of equal id and text have equal spans
    terms = term_spans(docs, found, id_col, text_col, disclosure, min_texts)
    gone = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("by")))
    edits = base.select("_id", "_text", F.concat(*map(edit, KINDS)).alias("_e")).unionByName(terms.select("_id", "_text", gone.alias("_e")))
    edits = edits.groupBy(F.col("_id").alias("_i"), F.col("_text").alias("_x")).agg(F.flatten(F.collect_list("_e")).alias("_e"))

    def rewrite(text: Column) -> Column:
        # of overlapping spans the first to start stays, and takes in what overlaps it
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, e: Column) -> Column:
            fresh = e["start"] >= acc["at"]
            gap = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], e["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, e["by"]))).otherwise(acc["out"]).alias("out"))

        def end(acc: Column) -> Column:
            return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

        return F.aggregate(F.array_sort("_e"), zero, step, end)

    # the row travels as one column, so that none of its names can clash
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    joined = packed.join(edits, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_x")), "left")
    new = F.when(F.col("_e").isNull(), F.col(f"_row.`{text_col}`")).otherwise(let(text, rewrite))
    return joined.select(*((new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")

    def shown_as(spans: str, kind: str) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    shown = F.concat(*(shown_as(f"base.{k}", k) for k in KINDS))
    extra = shown_as("terms", "term")
    return personal_data(docs).select(
        "doc_id",
        *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", shown), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(shown, extra)).alias("spans"),
    )
