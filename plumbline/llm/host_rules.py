"""Quality rules with host verdicts.

Each document is measured against a few rules. Their failures are summed by host, each
host's failure rates are shrunk towards an empirical beta prior, and the verdict on the host
is joined back to its documents.

Defined results: a null or empty text has no words and fails; a null host is a host of its
own; repeated rows are measured and returned each; columns of the input named like results give way
to them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import NOT_SPACE, SPACES, let, read, stored, words

#: Words in a window whose repetition counts, and the symbols that mark junk.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _repeated_words(tokens: Column) -> Column:
    """Words that lie in a window which the text holds twice or more."""

    def covered(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            pairs = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        def spread(at: Column) -> Column:
            n = F.size(at)
            gaps = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g)

        return let(let(by_hash, positions), spread)

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        repeats = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
        return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(repeats)

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return docs.select(
        "*",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("_w"),
    ).select("*", "_w.n_words", "_w.n_repeat_words").drop("_w")


MIN_WORDS, MAX_REPEAT_PCT = 20, 30


def host_rules(min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT) -> dict[str, str]:
    """Rules by which hosts are judged, over the measures above."""
    return {
        "short": f"n_words < {min_words}",
        "repeats": f"100 * n_repeat_words > {max_repeat_pct} * n_words",
        "symbols": "10 * n_symbols > word_chars",
        "dup_lines": "n_dup_lines > 0 and 10 * n_dup_lines > n_words",
        "long_words": "word_chars > 40 * n_words",
    }


HOST_RULES = host_rules()


#: Columns of the result besides those of the documents and the rates.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_passes", "kept", "_w", "_host", *(f"rate_{x}" for x in HOST_RULES)]


def judge_hosts(measured: DataFrame, host_col: str, max_rate: float = 0.5, rules: dict[str, str] = HOST_RULES) -> DataFrame:
    """One row a host: shrunken failure rate of each rule, and whether the host passes.

    The prior of a rule is the beta distribution whose mean is the corpus rate and whose
    variance is what the hosts' rates vary beyond binomial noise (method of moments).
    """
    fails = [F.sum(F.expr(f"cast({rule} as long)")).alias(f"x_{name}") for name, rule in rules.items()]
    # stored, so that the join back reads two plain exchanges and Spark can split a hot host's rows
    hosts = stored(measured.groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *fails), "hosts")
    moments = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
    for name in HOST_RULES:
        moments += [F.sum(f"x_{name}").alias(f"x_{name}"), F.sum(F.col(f"x_{name}") * F.col(f"x_{name}") / F.col("n")).alias(f"xx_{name}")]
    m = hosts.agg(*moments).first()  # one row of sums
    rates = []
    for name in HOST_RULES:
        n = float(m["n"] or 1)
        mean = (m[f"x_{name}"] or 0) / n
        noise = mean * (1 - mean)
        between = (m[f"xx_{name}"] or 0) / n - mean * mean - noise * m["k"] / n
        strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 and noise > 0 else 1e6
        rates.append(((F.col(f"x_{name}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{name}"))
    judged = hosts.select("_host", *rates)
    return judged.withColumn("host_passes", F.greatest(*(F.col(f"rate_{x}") for x in HOST_RULES)) <= F.lit(max_rate))


def host_quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, max_rate: float = 0.5
) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed, host_passes and kept.

    ``kept`` is false where the document fails a base rule or its host's verdict is against it.
    """
    docs = docs.drop(*(c for c in RESULTS if c not in (text_col, host_col)))  # ours replace columns of the same name
    measured = stored(measure(docs, text_col).drop(text_col), "measures")
    measured = measured.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    hosts = judge_hosts(measured, host_col, max_rate, host_rules(min_words, max_repeat_pct))
    joined = measured.join(hosts, measured[host_col].eqNullSafe(hosts["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_passes", F.lit(True)))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return host_quality_rules(docs).select(*columns)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, p, list_aggregate(ws[p:p + 7], 'string_agg', ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS r(p)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM dup, range(0, 8) AS r(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, unnest([
  {'rule': 'short', 'bad': n_words < 20}, {'rule': 'repeats', 'bad': 100 * n_repeat_words > 30 * n_words},
  {'rule': 'symbols', 'bad': 10 * n_symbols > word_chars},
  {'rule': 'dup_lines', 'bad': n_dup_lines > 0 AND 10 * n_dup_lines > n_words},
  {'rule': 'long_words', 'bad': word_chars > 40 * n_words}], recursive := true) FROM m),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS x FROM f GROUP BY ALL),
g AS (SELECT rule, sum(n) AS n, count(*) AS k, sum(x) / sum(n) AS mean, sum(x * x / n) AS xx FROM h GROUP BY rule),
b AS (SELECT rule, mean, mean * (1 - mean) AS noise, xx / n - mean * mean - mean * (1 - mean) * k / n AS between_hosts FROM g),
s AS (SELECT rule, mean, CASE WHEN between_hosts > 0 AND noise > 0 THEN least(greatest(noise / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM b),
v AS (SELECT source, max((x + mean * strength) / (n + strength)) <= 0.5 AS passes FROM h JOIN s USING (rule) GROUP BY source),
q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept
FROM q LEFT JOIN v ON q.source IS NOT DISTINCT FROM v.source
"""
