"""Queries over the provided tables, one or more for each family of operators, and the SQL that checks them.

The tables hold no poses, so a user's events stand for a clip: time is ``ts``, the signal is
``value``, the visibility is ``k`` of ``props``, and errors are frames without a person. Suppliers'
line items stand for holds, and the first elements of a vector for points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import text
from plumbline.operators import comparison, kernels, people, reports, runs, sampling, scoring, stats, timeops, upsert
from plumbline.streaming import live

HALF_DAY, DAY = 43_200.0, 86_400.0
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL where SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{PREFIX}\n{sql}"
        return f

    return register


PREFIX = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value AS x, value / 2 AS y, (props::JSON->>'$.k')::DOUBLE / 100 AS vis, event_type,
  coalesce(event_type <> 'error' AND value IS NOT NULL AND (props::JSON->>'$.k')::DOUBLE / 100 >= 0.3, false) AS ok FROM events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    vis = F.get_json_object("props", "$.k").cast("double") / 100
    return ev.select(
        "user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), vis.alias("vis"), "event_type",
        timeops.gated(F.col("value"), vis, F.col("event_type") != "error", 0.3).alias("ok"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


KEYS = ["user_id"]
ORDER = ["t", "event_id"]


@query("SELECT event_id, ok FROM e")
def gate_filter(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", "ok")


@query("""SELECT user_id, CASE WHEN least(nx, ny) >= 10 AND qx + qy >= 1 THEN round(qx + qy, 4) END AS body_length,
  CASE WHEN nx < 10 THEN 'too few rows of x' WHEN ny < 10 THEN 'too few rows of y' WHEN qx + qy < 1 THEN 'too short' ELSE '' END AS reason
FROM (SELECT user_id, quantile_cont(x, 0.9) AS qx, quantile_cont(y, 0.9) AS qy, count(x) AS nx, count(y) AS ny FROM e WHERE ok GROUP BY user_id)""")
def body_length(spark, sf_dir):
    return rounded(stats.body_length(series(spark, sf_dir).where("ok"), KEYS, ["x", "y"]), "body_length")


@query(f"""SELECT event_id, round(CASE WHEN f THEN px + (nx - px) * (t - pt) / (nt - pt) ELSE x END, 4) AS x, ok OR f AS ok, f AS filled FROM (
  SELECT *, coalesce(NOT ok AND nt - pt > 0 AND nt - pt <= {DAY}, false) AS f FROM (SELECT *,
    last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER w AS pt, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w AS px,
    first_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER v AS nt, first_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER v AS nx FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           v AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))""")
def gap_fill_linear(spark, sf_dir):
    return rounded(timeops.fill_gaps(series(spark, sf_dir), KEYS, "t", "event_id", ["x"], "ok", DAY).select("event_id", "x", "ok", "filled"), "x")


@query(f"""SELECT a.event_id, round(CASE WHEN a.ok AND b.ok AND a.t > b.t THEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 100 END, 4) AS step
FROM e a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.t - {HALF_DAY} >= b.t""")
def window_motion_asof(spark, sf_dir):
    return rounded(timeops.window_motion(series(spark, sf_dir), KEYS, "t", "x", "y", "ok", 100.0, HALF_DAY).select("event_id", "step"), "step")


@query(f"""SELECT event_id, round(CASE WHEN ok AND ak AND bk AND tb > ta THEN (bx - ax) / (tb - ta) END, 8) AS velocity FROM (SELECT *,
  coalesce(last_value(ok) OVER p, first_value(ok) OVER w) AS ak, coalesce(last_value(t) OVER p, first_value(t) OVER w) AS ta, coalesce(last_value(x) OVER p, first_value(x) OVER w) AS ax,
  coalesce(first_value(ok) OVER f, last_value(ok) OVER w) AS bk, coalesce(first_value(t) OVER f, last_value(t) OVER w) AS tb, coalesce(first_value(x) OVER f, last_value(x) OVER w) AS bx
  FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY / 2 - 1e-9} PRECEDING),
    f AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY / 2 - 1e-9} FOLLOWING AND UNBOUNDED FOLLOWING),
    w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def centred_velocity(spark, sf_dir):
    return rounded(timeops.centred_velocity(series(spark, sf_dir), KEYS, "t", "x", "ok", DAY).select("event_id", "velocity"), "velocity", digits=8)


@query(f"""SELECT event_id, round(avg(x) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {HALF_DAY} PRECEDING AND {HALF_DAY} FOLLOWING), 6) AS smoothed FROM e""")
def centred_moving_avg(spark, sf_dir):
    return rounded(timeops.centred_mean(series(spark, sf_dir), KEYS, "t", "x", DAY).select("event_id", "smoothed"), "smoothed", digits=6)


@query("""SELECT user_id, round(median(CASE WHEN ok AND pk THEN sqrt((x - px) ** 2 + (y - py) ** 2) / 100 END), 4) AS jitter FROM (
  SELECT *, lag(ok) OVER w AS pk, lag(x) OVER w AS px, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) GROUP BY user_id""")
def jitter_median(spark, sf_dir):
    return rounded(timeops.median_jitter(series(spark, sf_dir), KEYS, "t", "event_id", "x", "y", "ok", 100.0), "jitter")


DURATIONS = """d AS (SELECT *, coalesce(g, median(g) OVER (PARTITION BY user_id)) AS duration FROM (
  SELECT *, CASE WHEN n > t THEN n - t END AS g FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e)))"""


@query(f", {DURATIONS} SELECT event_id, round(duration, 3) AS duration FROM d")
def frame_durations(spark, sf_dir):
    return rounded(timeops.frame_durations(series(spark, sf_dir), KEYS, "t", "event_id").select("event_id", "duration"), "duration", digits=3)


@query(f""", {DURATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY t, event_id) AS run FROM d),
s AS (SELECT user_id, ok, run, sum(duration) AS t, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, round(coalesce(sum(t) FILTER (ok), 0), 3) AS flagged, round(coalesce(max(t) FILTER (ok), 0), 3) AS longest, coalesce(max(n) FILTER (ok), 0) AS longest_rows FROM s GROUP BY user_id""")
def flagged_seconds(spark, sf_dir):
    timed = timeops.frame_durations(series(spark, sf_dir), KEYS, "t", "event_id")
    return rounded(runs.flagged_time(timed, KEYS, ORDER, "ok", "duration"), "flagged", "longest", digits=3)


@query("SELECT user_id, round((count(*) - 1) / nullif(max(t) - min(t), 0), 8) AS rate FROM e GROUP BY user_id")
def frame_rate(spark, sf_dir):
    return rounded(timeops.rate_per_second(series(spark, sf_dir), KEYS, "t"), "rate", digits=8)


# A sequential automaton as a recursive query over each user's rows in order.
HOLDS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, ok AND x < 60 AS h, coalesce(event_type = 'purchase', false) AS ev FROM e),
st AS (SELECT user_id, n, t, h, ev, CASE WHEN h THEN 1 ELSE 0 END AS run, CASE WHEN h THEN n ELSE NULL END AS last_hold, NULL::DOUBLE AS gap_from, h AS inside FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.t, o.h, o.ev,
    CASE WHEN o.h AND NOT st.inside THEN st.run + 1 ELSE st.run END,
    CASE WHEN o.h THEN o.n WHEN st.inside AND o.ev THEN o.n - 1 ELSE st.last_hold END,
    CASE WHEN o.h THEN NULL ELSE coalesce(st.gap_from, o.t) END,
    o.h OR (st.inside AND NOT o.ev AND o.t - coalesce(st.gap_from, o.t) <= {DAY})
  FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1),
rn AS (SELECT user_id, run, min(n) FILTER (h) AS first_n, max(last_hold) AS last_n FROM st WHERE run > 0 GROUP BY user_id, run),
rt AS (SELECT rn.*, a.t AS t0, b.t AS t1 FROM rn JOIN o a ON a.user_id = rn.user_id AND a.n = first_n JOIN o b ON b.user_id = rn.user_id AND b.n = last_n WHERE b.t - a.t >= {HALF_DAY}),
hd AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_n) - 1 AS hold_id FROM rt),
hx AS (SELECT o.*, coalesce(hd.hold_id, -1) AS hold_id FROM o LEFT JOIN hd ON o.user_id = hd.user_id AND o.n BETWEEN hd.first_n AND hd.last_n)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumns({"h": F.col("ok") & (F.col("x") < 60), "ev": F.coalesce(F.col("event_type") == "purchase", F.lit(False))})
    return runs.hold_runs(s, KEYS, "t", "event_id", "h", "ev", HALF_DAY, DAY)


RECURSIVE = PREFIX.replace("WITH e AS", "WITH RECURSIVE e AS")


@query()
def hold_runs(spark, sf_dir):
    return held(spark, sf_dir).select("event_id", F.col("hold_id").cast("bigint").alias("hold_id"))


ORACLE_SQL["hold_runs"] = f"{RECURSIVE}, {HOLDS} SELECT event_id, hold_id::BIGINT AS hold_id FROM hx"


@query()
def phase_automaton(spark, sf_dir):
    s = held(spark, sf_dir).withColumns({"low": F.col("x") > 20, "rising": F.col("y") > 40})
    return runs.phases(s, KEYS, "t", "event_id", "ok", "low", "rising", "low").select("event_id", "phase")


ORACLE_SQL["phase_automaton"] = f"""{RECURSIVE}, {HOLDS},
k AS (SELECT *, hold_id >= 0 AS inside, last_value(CASE WHEN ok THEN hold_id >= 0 END IGNORE NULLS) OVER b AS was FROM hx
  WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN inside THEN 'hold' WHEN coalesce(was, false) THEN 'exit' WHEN x > 20 AND y > 40 THEN 'kickup' WHEN NOT x > 20 THEN 'down' END AS mark FROM k),
p AS (SELECT *, CASE WHEN mark = 'down' THEN CASE WHEN coalesce(max((mark IN ('hold', 'kickup'))::INT) OVER b, 0) = 1 THEN 'post' ELSE 'pre' END ELSE mark END AS mark2 FROM m
  WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN inside THEN 'hold' WHEN NOT ok THEN 'unknown' ELSE coalesce(last_value(mark2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'pre') END AS phase FROM p"""

RLE = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS g FROM e),
s AS (SELECT user_id, event_type, g, count(*) AS rows, min(t) AS a, max(t) AS b, min(n) AS n FROM r GROUP BY ALL)"""


@query(f", {RLE} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY n) - 1)::BIGINT AS run, event_type, rows, round(a, 3) AS start, round(b, 3) AS \"end\" FROM s")
def rle_segments(spark, sf_dir):
    return rounded(runs.run_lengths(series(spark, sf_dir), KEYS, ORDER, "event_type", "t"), "start", "end", digits=3)


@query(f", {RLE} SELECT user_id, count(*) AS runs, count(*) - 1 AS changes, count(*) FILTER (rows <= 3) AS short_runs FROM s GROUP BY user_id")
def orientation_changes(spark, sf_dir):
    return runs.change_counts(series(spark, sf_dir), KEYS, ORDER, "event_type")


@query("""SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY n) - 1)::BIGINT AS nth, rows FROM (SELECT user_id, g, count(*) AS rows, min(n) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, d ORDER BY t, event_id) AS g
  FROM (SELECT *, coalesce((x > 50) <> (vis > 0.5), false) AS d FROM e)) WHERE d GROUP BY ALL)""")
def changed_runs(spark, sf_dir):
    from pyspark.sql import Window

    found = runs.changed_runs(series(spark, sf_dir), KEYS, ORDER, F.col("x") > 50, F.col("vis") > 0.5)
    return found.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("run")) - 1).cast("bigint").alias("nth"), "rows")


@query(f"""SELECT a.user_id, a.at, b.event_id FROM (SELECT user_id, min(t) + (max(t) - min(t)) * 0.5 AS at FROM e GROUP BY user_id) a, LATERAL (
  SELECT event_id FROM e WHERE e.user_id = a.user_id ORDER BY abs(e.t - a.at), e.t, event_id DESC LIMIT 1) b""")
def nearest_frame(spark, sf_dir):
    s = series(spark, sf_dir)
    wanted = s.groupBy("user_id").agg((F.min("t") + (F.max("t") - F.min("t")) * 0.5).alias("at"))
    return timeops.nearest_rows(s, KEYS, "t", "event_id", wanted, "at").select("user_id", "at", "event_id")


@query("""SELECT event_id, CASE WHEN x >= 10 AND t BETWEEN (SELECT min(t) + 86400 FROM e) AND (SELECT max(t) - 86400 FROM e) AND floor(x / 10) = 3 THEN floor(x / 10)::BIGINT ELSE -1 END AS hold FROM e WHERE x IS NOT NULL""")
def window_cut(spark, sf_dir):
    s = series(spark, sf_dir).where("x is not null").withColumn("hold", F.floor(F.col("x") / 10))
    ends = s.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # two numbers
    return scoring.window_cut(s, "hold", 3, "t", F.lit(ends["a"] + DAY), F.lit(ends["b"] - DAY)).select("event_id", "hold")


@query("""SELECT g.user_id, g.bin::INT AS bin, round(max(x), 4) AS peak FROM (SELECT user_id, a, b, unnest(range(10)) AS bin FROM (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY user_id)) g
LEFT JOIN e ON e.user_id = g.user_id AND least(floor((t - a) * 10 / greatest(b - a, 1e-9)), 9) = g.bin GROUP BY g.user_id, g.bin""")
def heat_bins(spark, sf_dir):
    return rounded(scoring.heat_strip(series(spark, sf_dir), KEYS, "t", "x", 10), "peak")


@query(f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY vis DESC, t) AS r FROM (
  SELECT *, min(t) OVER (PARTITION BY user_id, event_type) AS a, max(t) OVER (PARTITION BY user_id, event_type) AS b FROM e) WHERE t >= a + {HALF_DAY} AND t <= b - {HALF_DAY} AND vis >= 0.5) WHERE r = 1""")
def worst_moment(spark, sf_dir):
    return scoring.worst_moment(series(spark, sf_dir), KEYS, "event_type", "t", "vis", HALF_DAY).select("user_id", "event_id")


@query("""SELECT user_id, round(median(x), 4) AS forward_median, round(CASE WHEN count(x) > 1 THEN stddev_pop(x) END, 4) AS sway_sd, round(CASE WHEN count(x) > 1 THEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) END, 4) AS sway_range,
  round(sqrt(avg(CASE WHEN dt > 0 THEN (dx / dt) ** 2 END)), 6) AS speed_rms, round(100.0 * count(*) FILTER (x > 60) / count(*), 4) AS pct_over, round(100.0 * count(*) FILTER (x < 30) / count(*), 4) AS pct_under, round(any_value(vs), 4) AS vis_sd
FROM (SELECT *, x - lag(x) OVER w AS dx, t - lag(t) OVER w AS dt FROM e JOIN (SELECT user_id, CASE WHEN count(vis) > 1 THEN stddev_pop(vis) END AS vs FROM e GROUP BY user_id) USING (user_id) WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)) GROUP BY user_id""")
def stability_summary(spark, sf_dir):
    found = stats.stability(series(spark, sf_dir), KEYS, "t", "x", ["vis"], back=-30, front=60)
    return rounded(rounded(found, "forward_median", "sway_sd", "sway_range", "pct_over", "pct_under", "vis_sd"), "speed_rms", digits=6)


@query("""SELECT user_id, CASE WHEN count(*) FILTER (n = most) = 1 THEN max(event_type) FILTER (n = most) END AS event_type FROM (
  SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL)) GROUP BY user_id""")
def majority_vote(spark, sf_dir):
    return stats.vote(series(spark, sf_dir), KEYS, "event_type")


@query("""SELECT event_id, (CASE WHEN p > m THEN 1 WHEN m > p THEN -1 ELSE s END)::INT AS facing FROM (SELECT *, count(*) FILTER (s > 0) OVER (PARTITION BY user_id, event_type) AS p, count(*) FILTER (s < 0) OVER (PARTITION BY user_id, event_type) AS m
  FROM (SELECT *, CASE WHEN x > 50 THEN 1 WHEN x < 50 THEN -1 END AS s FROM e))""")
def majority_facing(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("s", geo.sign(F.col("x") - 50))
    return s.select("event_id", stats.majority_sign("s", ["user_id", "event_type"]).cast("int").alias("facing"))


LINES = "l AS (SELECT l_suppkey, l_linenumber, l_orderkey, epoch(l_shipdate::TIMESTAMP) / 86400 AS day, l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, l_returnflag <> 'R' AS valid FROM lineitem)"
FEATURES = ["quantity", "price", "discount", "tax"]
RULES = scoring.Rules(
    groups=(("size", 0.6, ("quantity", "price")), ("terms", 0.4, ("discount", "tax", "sway"))), spreads={"sway": "discount", "wander": "quantity"}, angles=("quantity",), one_sided=("quantity",), signed=(), penalty=("wander", 0.1)
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("double")
    return li.select(
        "l_suppkey", "l_linenumber", "l_orderkey", day.alias("day"), *(F.col(f"l_{c}").cast("double").alias(n) for n, c in (("quantity", "quantity"), ("price", "extendedprice"), ("discount", "discount"), ("tax", "tax"))), (F.col("l_returnflag") != "R").alias("valid")
    )


@query(f""", {LINES} SELECT l_suppkey, round(median(quantity), 4) AS quantity_median, round(quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25), 4) AS quantity_iqr, round(median(price), 4) AS price_median, round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS price_iqr FROM l WHERE valid GROUP BY l_suppkey""")
def median_iqr_summary(spark, sf_dir):
    agg = lines(spark, sf_dir).where("valid").groupBy("l_suppkey").agg(*stats.spread("quantity"), *stats.spread("price"))
    return rounded(agg, "quantity_median", "quantity_iqr", "price_median", "price_iqr")


REFERENCE = f"{LINES}, f AS (UNPIVOT (SELECT quantity, price, discount, tax FROM l WHERE valid) ON quantity, price, discount, tax INTO NAME feature VALUE v), rf AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n FROM f GROUP BY feature HAVING count(v) >= 5)"


@query(f", {REFERENCE} SELECT feature, round(mean, 4) AS mean, round(sd, 4) AS sd, n FROM rf")
def reference_stats(spark, sf_dir):
    return stats.reference_stats(lines(spark, sf_dir).where("valid"), FEATURES, digits=4)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds of suppliers' line numbers against the reference of all valid lines."""
    li = lines(spark, sf_dir)
    values = scoring.hold_values(li, ["l_suppkey", "l_linenumber"], "day", RULES, facing=None)
    holds = values.where(F.col("valid_frames") > 0)
    by_feature = stats.reference_stats(holds, RULES.features)
    return scoring.score_holds(values, scoring.reference_columns(by_feature, RULES), RULES)


HOLD_VALUES = f"""{LINES}, hv AS (SELECT l_suppkey, l_linenumber, count(*) AS hold_frames, count(*) FILTER (valid) AS valid_frames, median(quantity) FILTER (valid) AS quantity, median(price) FILTER (valid) AS price,
  median(discount) FILTER (valid) AS discount, median(tax) FILTER (valid) AS tax, CASE WHEN count(*) FILTER (valid) > 1 THEN stddev_pop(discount) FILTER (valid) END AS sway, CASE WHEN count(*) FILTER (valid) > 1 THEN stddev_pop(quantity) FILTER (valid) END AS wander FROM l GROUP BY ALL),
lv AS (UNPIVOT (SELECT quantity, price, discount, tax, sway, wander FROM hv WHERE valid_frames > 0) ON quantity, price, discount, tax, sway, wander INTO NAME feature VALUE v),
rs AS (SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM lv GROUP BY feature HAVING count(v) >= 5),
fl(feature, fl, grp, w, size, ord) AS (VALUES ('quantity', 3.0, 'size', 0.6, 2, 0), ('price', 0.01, 'size', 0.6, 2, 1), ('discount', 0.01, 'terms', 0.4, 3, 2), ('tax', 0.01, 'terms', 0.4, 3, 3), ('sway', 0.01, 'terms', 0.4, 3, 4), ('wander', 0.01, NULL, 0, 1, 5)),
z AS (SELECT u.*, fl.*  EXCLUDE (feature), greatest(-4.0, least(4.0, CASE WHEN u.feature = 'quantity' THEN least((v - mean) / greatest(sd, fl), 0) ELSE (v - mean) / greatest(sd, fl) END)) AS z
  FROM (UNPIVOT (SELECT l_suppkey, l_linenumber, quantity, price, discount, tax, sway, wander FROM hv WHERE valid_frames >= 5) ON quantity, price, discount, tax, sway, wander INTO NAME feature VALUE v) u JOIN rs USING (feature) JOIN fl ON fl.feature = u.feature),
g AS (SELECT l_suppkey, l_linenumber, grp, any_value(w) AS w, avg(abs(z)) AS d FROM z WHERE grp IS NOT NULL GROUP BY ALL),
dv AS (SELECT l_suppkey, l_linenumber, sum(w * d) / sum(w) AS deviation FROM g GROUP BY ALL),
pn AS (SELECT l_suppkey, l_linenumber, 0.1 * greatest(0, max(z)) AS penalty FROM z WHERE feature = 'wander' GROUP BY ALL),
sc AS (SELECT hv.l_suppkey, hv.l_linenumber, hold_frames, valid_frames, CASE WHEN valid_frames >= 5 THEN 100 * greatest(0, 1 - (deviation + coalesce(penalty, 0)) / 4) END AS score, CASE WHEN valid_frames < 5 THEN 'too few valid frames' WHEN deviation IS NULL THEN 'nothing to compare' ELSE '' END AS reason
  FROM hv LEFT JOIN dv USING (l_suppkey, l_linenumber) LEFT JOIN pn USING (l_suppkey, l_linenumber))"""


@query(f", {HOLD_VALUES} SELECT l_suppkey, l_linenumber, hold_frames, valid_frames, round(score, 1) AS score, reason FROM sc")
def clip_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("l_suppkey", "l_linenumber", "hold_frames", "valid_frames", "score", "reason")


@query(f", {HOLD_VALUES} SELECT l_suppkey, l_linenumber, feature, round(z, 4) AS z, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY w * abs(z) / size DESC, ord) AS rank FROM z WHERE grp IS NOT NULL) WHERE rank <= 3")
def top_faults(spark, sf_dir):
    out = scored(spark, sf_dir).select("l_suppkey", "l_linenumber", F.posexplode("top_faults").alias("i", "f"))
    return out.select("l_suppkey", "l_linenumber", "f.feature", F.round("f.z", 4).alias("z"), (F.col("i") + 1).cast("bigint").alias("rank"))


@query(f", {HOLD_VALUES} SELECT l_suppkey, l_linenumber, round(score, 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(score, 1) DESC, l_linenumber) AS r FROM sc WHERE score IS NOT NULL) WHERE r = 1")
def best_hold(spark, sf_dir):
    return scoring.best_hold(scored(spark, sf_dir), ["l_suppkey"], "l_linenumber").select("l_suppkey", "l_linenumber", "score")


@query("""SELECT a.s_suppkey, round((sum(b.s_acctbal)) / count(b.s_acctbal), 4) AS loo_mean, round(stddev_samp(b.s_acctbal), 4) AS loo_sd FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey""")
def leave_one_out(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("v"))
    return rounded(scoring.leave_one_out(s, "v", ["s_nationkey"]).select("s_suppkey", "loo_mean", "loo_sd"), "loo_mean", "loo_sd")


@query(f""", {LINES} SELECT l_suppkey, count(discount) AS view_frames, round(median(discount), 4) AS view_width, CASE WHEN count(discount) < 15 THEN 'unsure' WHEN median(discount) < 0.03 THEN 'side' WHEN median(discount) >= 0.036 THEN 'not_side' ELSE 'unsure' END AS view FROM l GROUP BY l_suppkey""")
def view_class(spark, sf_dir):
    return rounded(stats.view_class(lines(spark, sf_dir), ["l_suppkey"], "discount"), "view_width")


@query(f""", {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN quantity * 4 < 120 THEN 'tuck' WHEN tax * 1000 > 45 THEN 'straddle' WHEN discount * 2000 < 140 THEN 'pike' ELSE 'line' END AS shape FROM l""")
def predicted_shape(spark, sf_dir):
    shape = geo.predicted_shape(F.col("tax") * 1000, F.col("quantity") * 4, F.col("discount") * 2000)
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", shape.alias("shape"))


GATES = [round(0.05 * i, 2) for i in range(20)]


@query(f"""SELECT event_type, g AS gate, count(*) FILTER (vis >= g) AS kept, round(count(*) FILTER (vis >= g AND x <= 50) / nullif(count(*) FILTER (vis >= g), 0), 6) AS precision FROM e, unnest({GATES}::DOUBLE[]) AS u(g) GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    return rounded(stats.gate_sweep(series(spark, sf_dir), ["event_type"], "x", "vis", 50.0, GATES), "precision", digits=6)


@query(f"""SELECT event_type, coalesce(min(g) FILTER (p >= 0.55), 0.5) AS gate, count(*) FILTER (p >= 0.55) > 0 AS met FROM (
  SELECT event_type, g, count(*) FILTER (vis >= g AND x <= 50) / nullif(count(*) FILTER (vis >= g), 0) AS p FROM e, unnest({GATES}::DOUBLE[]) AS u(g) GROUP BY ALL) GROUP BY event_type""")
def recommended_gate(spark, sf_dir):
    return stats.recommended_gate(stats.gate_sweep(series(spark, sf_dir), ["event_type"], "x", "vis", 50.0, GATES), ["event_type"], target=0.55)


@query("""SELECT event_type, user_id % 4 AS slice, round(avg((coalesce(vis >= 0.5 AND x <= 50, false))::INT), 6) AS pck, round(avg((NOT coalesce(vis >= 0.5, false))::INT), 6) AS miss_rate, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type), ())""")
def grouping_sets_metrics(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("slice", F.col("user_id") % 4)
    return s.groupingSets([["event_type", "slice"], ["event_type"], []], "event_type", "slice").agg(F.round(stats.pck("x", "vis", 0.5, 50.0), 6).alias("pck"), F.round(stats.miss_rate("vis", 0.5), 6).alias("miss_rate"), F.count(F.lit(1)).alias("n"))


@query(
    """, s AS (SELECT event_type, user_id, count(*) FILTER (coalesce(x <= 50, false)) AS num, count(*) AS den FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM s),
d AS (SELECT event_type, b AS sample, ('0x' || substr(md5('16:' || b || ':' || nth), 1, 15))::BIGINT % n AS nth FROM k, range(1, 1001) r(b)),
t AS (SELECT event_type, sample, sum(num) / sum(den) AS r FROM d JOIN k USING (event_type, nth) GROUP BY ALL)
SELECT event_type, (SELECT round(sum(num) / sum(den), 6) FROM s WHERE s.event_type = t.event_type) AS ratio, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM t GROUP BY event_type"""
)
def bootstrap_ci(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"hit": F.coalesce(F.col("x") <= 50, F.lit(False)).cast("int"), "one": F.lit(1)})
    return rounded(stats.bootstrap_ratio(s, "user_id", "hit", "one", ["event_type"]), "ratio", "low", "high", digits=6)


MODELS = {"first": "view", "preferred": "click", "bound": "purchase"}
SETTINGS = {"recommended": 50, "common": 40}


def model_decision(spark, sf_dir):
    """Kinds of events stand for models, and a limit of the value for a setting."""
    s = series(spark, sf_dir).withColumns({"one": F.lit(1), "part": F.col("user_id") % 4})
    hit = lambda limit: F.coalesce(F.col("x") <= limit, F.lit(False)).cast("int")
    found = [rounded(stats.bootstrap_ratio(s.withColumn("hit", hit(v)), "user_id", "hit", "one", ["event_type"]), "ratio", "low", "high", digits=6).withColumn("setting", F.lit(k)) for k, v in SETTINGS.items()]
    headline = found[0].unionByName(found[1]).withColumnsRenamed({"event_type": "model", "ratio": "rate"})
    groups = s.groupBy(F.col("event_type").alias("model"), "part").agg(F.avg(hit(40)).alias("rate"))
    return rounded(comparison.decision(headline, groups, *MODELS.values()), "headroom", "first_worst", "preferred_worst", digits=6)


QUERIES["model_decision"] = model_decision
_RATE = lambda k, s, c: f"max({c}) FILTER (model = '{MODELS[k]}' AND setting = '{s}') AS {k}_{s}_{c}"
ORACLE_SQL["model_decision"] = f"""WITH hl AS ({' UNION ALL '.join(f"SELECT '{k}' AS setting, event_type AS model, ratio AS rate, low, high FROM ({ORACLE_SQL['bootstrap_ci'].replace('x <= 50', f'x <= {v}')})" for k, v in SETTINGS.items())}),
fg AS (SELECT {', '.join(_RATE(k, s, c) for k in MODELS for s in SETTINGS if (k, s) != ('bound', 'common') for c in ('rate', 'low', 'high'))} FROM hl),
wg AS (SELECT min(r) FILTER (event_type = 'view') AS first_worst, min(r) FILTER (event_type = 'click') AS preferred_worst FROM (SELECT event_type, avg(coalesce(value <= 40, false)::INT) AS r FROM events GROUP BY event_type, user_id % 4)),
dc AS (SELECT *, first_recommended_high >= preferred_recommended_low AND preferred_recommended_high >= first_recommended_low AS overlap, first_common_high >= preferred_common_low AND preferred_common_high >= first_common_low AS meets FROM fg, wg)
SELECT * EXCLUDE (meets, first_worst, preferred_worst), round(first_worst, 6) AS first_worst, round(preferred_worst, 6) AS preferred_worst, CASE WHEN overlap OR preferred_recommended_rate > first_recommended_rate THEN 'click' ELSE 'view' END AS choice, NOT overlap AS decisive,
  CASE WHEN (preferred_common_rate > first_common_rate) <> (preferred_recommended_rate > first_recommended_rate) THEN 'differs' WHEN meets THEN 'same, intervals meet' ELSE 'same' END AS robust,
  round(bound_recommended_rate - greatest(first_recommended_rate, preferred_recommended_rate), 6) AS headroom, first_worst < 0.6 AND preferred_worst < 0.6 AS train FROM dc"""


@query("""SELECT b::INT AS bucket, count(x) AS n FROM range(10) AS r(b) LEFT JOIN e ON x BETWEEN 0 AND 100 AND least(floor(x / 10), 9) = b GROUP BY b""")
def contact_histogram(spark, sf_dir):
    return stats.histogram(series(spark, sf_dir), "x")


@query("""SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, list_position(['view', 'click', 'purchase', 'error', 'signup'], event_type)) = 1 AS dominant FROM e WHERE event_type IN ('view', 'click', 'purchase', 'error', 'signup') GROUP BY event_type""")
def reason_tally(spark, sf_dir):
    s = series(spark, sf_dir)
    return stats.tally(s, "event_type", ["view", "click", "purchase", "error", "signup"]).where("n > 0")


VECTORS = "v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abcd")))


def points():
    return geo.point(F.col("a"), F.col("b")), geo.point(F.col("c"), F.col("d"))


@query(f", {VECTORS} SELECT vec_id, round(degrees(atan2(abs(a * d - b * c), a * c + b * d)), 4) AS angle, round(CASE WHEN abs(d) > 1e-9 THEN c / d END, 4) AS ratio FROM v")
def angle_between(spark, sf_dir):
    p, q = points()
    return vectors(spark, sf_dir).select("vec_id", F.round(geo.angle_between(p, q), 4).alias("angle"), F.round(geo.ratio(F.col("c"), F.col("d")), 4).alias("ratio"))


@query(f""", {VECTORS}, w AS (SELECT vec_id, greatest(0, least(a + 1, c + 1) - greatest(a, c)) * greatest(0, least(b + 1, d + 1) - greatest(b, d)) AS i FROM v) SELECT vec_id, round(i / (2 - i), 6) AS iou FROM w""")
def box_iou(spark, sf_dir):
    p, q = points()
    box = lambda r: F.struct(r["x"].alias("x0"), r["y"].alias("y0"), (r["x"] + 1).alias("x1"), (r["y"] + 1).alias("y1"))
    return vectors(spark, sf_dir).select("vec_id", F.round(geo.box_iou(box(p), box(q)), 6).alias("iou"))


@query(f", {VECTORS} SELECT vec_id, round(99 - b, 4) AS qx, round(a, 4) AS qy, round(49.5 + (a - 49.5) * cos(radians(30)) - (b - 24.5) * sin(radians(30)), 4) AS tx, round(24.5 + (a - 49.5) * sin(radians(30)) + (b - 24.5) * cos(radians(30)), 4) AS ty FROM v")
def rotate_points(spark, sf_dir):
    p, q = points()
    quarter, turned = geo.rotate_point(p, 90, F.lit(100.0), F.lit(100.0)), geo.rotate_point(p, 30, F.lit(100.0), F.lit(50.0))
    return vectors(spark, sf_dir).select("vec_id", F.round(quarter["x"], 4).alias("qx"), F.round(quarter["y"], 4).alias("qy"), F.round(turned["x"], 4).alias("tx"), F.round(turned["y"], 4).alias("ty"))


@query(f""", {VECTORS}, s AS (SELECT *, greatest(0, least(1, (c * a + d * b) / nullif(c * c + d * d, 0))) AS u FROM v) SELECT vec_id, round(sqrt((a - u * c) ** 2 + (b - u * d) ** 2), 6) AS distance, CASE WHEN a < -0.03 THEN 'under' WHEN a > 0.06 THEN 'over' ELSE 'ok' END AS zone FROM s""")
def segment_distance(spark, sf_dir):
    p, q = points()
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return vectors(spark, sf_dir).select("vec_id", F.round(geo.segment_distance(p, origin, q), 6).alias("distance"), geo.balance_zone(F.col("a")).alias("zone"))


@query(f""", {VECTORS} SELECT vec_id, round((c * b - d * a) / sqrt(c * c + d * d), 6) AS offset, sign(c * b - d * a)::INT AS facing FROM v""")
def facing(spark, sf_dir):
    p, q = points()
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return vectors(spark, sf_dir).select("vec_id", F.round(geo.line_side(origin, q, p), 6).alias("offset"), geo.facing_sign(origin, q, p).alias("facing"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY x DESC NULLS LAST, event_id) AS r FROM e) WHERE r = 1""")
def lowest_wrists(spark, sf_dir):
    s = series(spark, sf_dir).withColumnRenamed("x", "wrist_y")
    return people.lowest_wrists(s, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def last_annotation_wins(spark, sf_dir):
    return upsert.last_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", "text")


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 0 AS quality, toxic FROM labels WHERE toxic = 1""")
def upsert_replace(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return upsert.replace_keys(labels, labels.where("toxic = 1").withColumn("quality", F.lit(0)), ["doc_id"])


@query("""SELECT coalesce(f.k, o.n_nationkey) AS key, CASE WHEN f.k IS NOT NULL THEN f.name ELSE o.n_name END AS name, o.n_regionkey AS region, f.k IS NULL AS missing FROM
  (SELECT n_nationkey + 5 AS k, upper(n_name) AS name FROM nation) f FULL OUTER JOIN nation o ON f.k = o.n_nationkey""")
def merge_dimension(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    fresh = nation.select((F.col("key") + 5).alias("key"), F.upper("name").alias("name"))
    return upsert.merge_dimension(nation, fresh, "key", ["name"], ["region"])


@query("""SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.quality ELSE n.quality END AS quality, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'kept' WHEN n.quality = o.quality THEN 'unchanged' ELSE 'updated' END AS change
FROM (SELECT doc_id + 1 AS doc_id, quality FROM labels) n FULL OUTER JOIN labels o ON n.doc_id = o.doc_id""")
def import_labels(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return upsert.import_labels(old, old.withColumn("doc_id", F.col("doc_id") + 1), ["doc_id"], ["quality"])


@query("""SELECT d.doc_id, substr(sha1(d.text), 1, 12) AS content_id, CASE WHEN d.doc_id <> f.first THEN f.first END AS copy_of FROM documents d JOIN (SELECT sha1(text) AS h, min(doc_id) AS first FROM documents GROUP BY ALL) f ON sha1(d.text) = f.h""")
def dedupe_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return upsert.first_of_content(d, F.col("text").cast("binary"), ["doc_id"]).select("doc_id", "content_id", F.col("copy_of.doc_id").alias("copy_of"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: round_even(k * (n - 1) / 4, 0)::BIGINT), i)""")
def pick_evenly(spark, sf_dir):
    return upsert.pick_evenly(series(spark, sf_dir), KEYS, ORDER, 5).select("user_id", "event_id")


@query("""SELECT event_id, bin, row_number() OVER (PARTITION BY user_id ORDER BY bin, abs(t - (a + s * (bin + 0.5) / 4)), event_id) AS pick_order FROM (
  SELECT *, least(floor((t - a) * 4 / s), 3)::INT AS bin FROM (SELECT *, min(t) OVER u AS a, greatest(max(t) OVER u - min(t) OVER u, 1) AS s FROM e WINDOW u AS (PARTITION BY user_id)))""")
def in_bin_order(spark, sf_dir):
    return sampling.in_bin_order(series(spark, sf_dir), KEYS, "t", "event_id", 4).select("event_id", "bin", F.col("pick_order").cast("bigint").alias("pick_order"))


@query("""SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR)) AS r FROM (
  SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'trainer_contact' WHEN quality = 0 THEN 'clean_trainer' ELSE 'clean_no_trainer' END AS stratum FROM documents d JOIN labels USING (doc_id)))
WHERE r <= CASE stratum WHEN 'clean_no_trainer' THEN 60 WHEN 'clean_trainer' THEN 25 ELSE 15 END""")
def stratum_quota_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("stratum", sampling.stratum(F.lit(True), F.col("toxic") == 1, F.col("quality") == 0))
    wanted = dict(zip(sampling.STRATA, sampling.quotas(100), strict=True))
    return sampling.fill_quotas(d, "stratum", [F.md5(F.col("doc_id").cast("string").cast("binary"))], wanted).select("doc_id", "stratum")


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(lower(trim(url)), '[\\s\\-.]+', '_', 'g'), '_+', '_', 'g'), '_'), '') AS joint, list_filter(list_transform(string_split(replace(coalesce(url, ''), '/', ' ; '), ';'), lambda x: trim(x)), lambda x: x <> '') AS parts,
  CASE WHEN contains(lower(coalesce(url, '')), 'page') THEN coalesce(url, '') WHEN trim(coalesce(url, '')) = '' THEN 'page' ELSE url || '; page' END AS notes, left(sha1(coalesce(html, '')), 12) AS content FROM pages""")
def parse_names(spark, sf_dir):
    """LAB3, STR9, STR13, ING5."""
    p = table(spark, sf_dir, "pages")
    parts = text.split_list(F.replace("url", F.lit("/"), F.lit(" ; ")))
    return p.select("page_id", text.normalised_joint(F.col("url")).alias("joint"), parts.alias("parts"), text.append_note(F.col("url"), "page").alias("notes"), text.content_id(F.coalesce("html", F.lit("")).cast("binary")).alias("content"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[\\s\\-.]+', '_', 'g'), '_+', '_', 'g') AS joint, p_partkey::VARCHAR || '_h' || p_size::VARCHAR || '_s1' AS segment, p_partkey::VARCHAR || '_7.jpg' AS image FROM part""")
def name_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    return p.select("p_partkey", text.normalised_joint(F.col("p_name")).alias("joint"), text.segment_key(k, F.col("p_size"), F.lit(1)).alias("segment"), text.image_name(k, F.lit(7)).alias("image"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 12 THEN '2026-07-22T' || lpad((n_nationkey % 12 + 12)::VARCHAR, 2, '0') || ':09:23' ELSE '' END AS recorded_at, CASE WHEN n_regionkey > 0 THEN round(30000.0 / (1000 + n_regionkey), 6) END AS fps FROM nation""")
def parse_stamps(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("WhatsApp Video 2026-07-22 at "), F.col("n_nationkey").cast("string"), F.lit(".09.23 PM.mp4"))
    rate = text.parse_frame_rate(F.when(F.col("n_regionkey") > 0, F.concat(F.lit("30000/"), (F.col("n_regionkey") + 1000).cast("string"))).otherwise("30/0"))
    return n.select("n_nationkey", text.recorded_at(name).alias("recorded_at"), F.round(rate, 6).alias("fps"))


@query()
def speed_outliers(spark, sf_dir):
    return kernels.remove_speed_outliers(series(spark, sf_dir), KEYS, "t", "event_id", "x", "y", "ok", 1.0, 0.002).select("event_id", "kept")


ORACLE_SQL["speed_outliers"] = f"""{RECURSIVE}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
s AS (SELECT user_id, n, event_id, ok AS kept, CASE WHEN ok THEN t END AS rt, CASE WHEN ok THEN x END AS rx, CASE WHEN ok THEN y END AS ry FROM o WHERE n = 1
UNION ALL SELECT user_id, n, event_id, k, CASE WHEN k THEN t ELSE rt END, CASE WHEN k THEN x ELSE rx END, CASE WHEN k THEN y ELSE ry END FROM (
  SELECT o.*, s.rt, s.rx, s.ry, o.ok AND coalesce(NOT (o.t > s.rt AND sqrt((o.x - s.rx) ** 2 + (o.y - s.ry) ** 2) / (o.t - s.rt) > 0.002), true) AS k FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
SELECT event_id, kept FROM s"""


@query()
def one_euro_filter(spark, sf_dir):
    # in days, so that the cutoffs fit the spacing of the events
    s = series(spark, sf_dir).withColumn("t", F.col("t") / DAY)
    return rounded(kernels.one_euro(s, KEYS, "t", "event_id", ["x"], "ok", 100.0).select("event_id", "x_smooth"), "x_smooth")


ORACLE_SQL["one_euro_filter"] = f"""{RECURSIVE}, o AS (SELECT *, t / {DAY} AS d, x / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
s AS (SELECT user_id, n, event_id, d, ok, v AS f, 0.0::DOUBLE AS sp FROM o WHERE n = 1
UNION ALL SELECT user_id, n, event_id, d, ok, CASE WHEN ok AND pk THEN a2 * v + (1 - a2) * pf ELSE v END, CASE WHEN ok AND pk THEN sp2 ELSE 0.0 END FROM (
  SELECT *, 1 / (1 + 1 / (2 * pi() * (1.0 + 0.3 * abs(sp2)) * dt)) AS a2 FROM (
    SELECT *, 1 / (1 + 1 / (2 * pi() * dt)) * (v - pf) / dt + (1 - 1 / (1 + 1 / (2 * pi() * dt))) * psp AS sp2 FROM (
      SELECT o.*, s.ok AS pk, s.f AS pf, s.sp AS psp, greatest(o.d - s.d, 0.001) AS dt FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))))
SELECT event_id, round(f * 100, 4) AS x_smooth FROM s"""


@query()
def orientation_hysteresis(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"margin": F.col("vis") - 0.5, "start": F.lit(False)})
    return kernels.switch_with_hysteresis(s, KEYS, "t", "event_id", "margin", "start", 0.05, HALF_DAY).select("event_id", "rotated")


ORACLE_SQL["orientation_hysteresis"] = f"""{RECURSIVE}, o AS (SELECT *, vis - 0.5 AS m, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS rotated, NULL::DOUBLE AS since FROM o WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN a AND t - since >= {HALF_DAY} THEN NOT rotated ELSE rotated END, CASE WHEN NOT a THEN NULL WHEN since IS NULL THEN t WHEN t - since >= {HALF_DAY} THEN NULL ELSE since END FROM (
  SELECT o.user_id, o.n, o.event_id, o.t, s.rotated, s.since, coalesce(abs(o.m) > 0.05 AND (o.m > 0) <> s.rotated, false) AS a FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
SELECT event_id, rotated FROM s WHERE n > 0"""


@query()
def thinned_frames(spark, sf_dir):
    return kernels.thin(series(spark, sf_dir), KEYS, "t", "event_id", DAY).select("user_id", "event_id")


ORACLE_SQL["thinned_frames"] = f"""{RECURSIVE}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
s AS (SELECT user_id, n, event_id, t AS kept_t, true AS keep FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN o.t - s.kept_t >= {DAY} THEN o.t ELSE s.kept_t END, o.t - s.kept_t >= {DAY} FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT user_id, event_id FROM s WHERE keep"""


@query()
def merged_segments(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "error", F.lit("unmeasured")).otherwise(F.col("event_type")))
    return rounded(runs.merge_short_segments(s, KEYS, "t", "event_type", 2 * DAY, tie="event_id"), "start", "end", digits=3)


ORACLE_SQL["merged_segments"] = f"""{RECURSIVE}, f AS (SELECT user_id, event_id, t, coalesce(last_value(nullif(event_type, 'error') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(nullif(event_type, 'error') IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'unmeasured') AS l FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, sum(CASE WHEN l IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, lag(l) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM f)),
g AS (SELECT user_id, run, any_value(l) AS l, min(t) AS s, max(t) AS e FROM c GROUP BY user_id, run),
m AS (SELECT user_id, list({{'l': l, 's': s, 'e': e}} ORDER BY run) AS r FROM g GROUP BY user_id
  UNION ALL SELECT user_id, list_concat(list_slice(r, 1, lo - 1), [{{'l': r[j].l, 's': r[lo].s, 'e': r[hi].e}}], list_slice(r, hi + 1, len(r))) FROM (
    SELECT *, CASE WHEN o >= 1 AND o <= len(r) AND r[o].l = r[j].l THEN least(i, j, o) ELSE least(i, j) END AS lo, CASE WHEN o >= 1 AND o <= len(r) AND r[o].l = r[j].l THEN greatest(i, j, o) ELSE greatest(i, j) END AS hi FROM (
      SELECT *, 2 * i - j AS o FROM (SELECT *, CASE WHEN i = 1 THEN 2 WHEN i = len(r) THEN i - 1 WHEN d[i + 1] > d[i - 1] THEN i + 1 ELSE i - 1 END AS j FROM (
        SELECT *, list_position(d, list_min(d)) AS i FROM (SELECT *, list_transform(r, lambda x: x.e - x.s) AS d FROM m WHERE len(r) > 1) WHERE list_min(d) < {2 * DAY}))))),
z AS (SELECT user_id, arg_min(r, len(r)) AS r FROM m GROUP BY user_id)
SELECT user_id, (i - 1)::BIGINT AS segment_id, r[i].l AS event_type, round(r[i].s, 3) AS start, round(r[i].e, 3) AS "end" FROM z, unnest(range(1, len(r) + 1)) AS x(i)"""


@query()
def athlete_choice(spark, sf_dir):
    """Suppliers are people, a nation a clip and the day of a shipment a frame. Whether the greatest flag is R is asked of truth values, which aggregate by hash."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    p = li.groupBy("s_nationkey", F.col("l_shipdate").alias("day"), F.col("l_suppkey").alias("person")).agg(
        F.max(F.col("l_quantity").cast("double")).alias("wrist_y"), F.min(F.col("l_quantity").cast("double")).alias("hip_x"), F.avg(F.col("l_discount").cast("double")).alias("hip_y"), F.lit(50.0).alias("length"),
        F.avg(F.col("l_tax").cast("double")).alias("visibility"), (F.bool_or(F.col("l_returnflag") == "R") & F.bool_and(F.col("l_returnflag") <= "R")).alias("inverted"),
    )
    p = p.withColumn("frame", F.unix_date(F.col("day").cast("date")).cast("bigint"))
    return rounded(people.choose_athlete(p, ["s_nationkey"], "frame", "person"), "score")


@query()
def live_line_events(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"up": F.col("ok"), "line": F.col("ok") & (F.col("x") < 60)}).withColumn("t", F.col("t") / DAY)
    return rounded(live.events(s, "user_id", "t", ["up", "line"], live.LineState, live.line_step), "t", "value", digits=6)


@query()
def live_form_events(spark, sf_dir):
    fault = F.when(F.col("x") > 70, "arch").when(F.col("x") < 30, "hips")
    s = series(spark, sf_dir).withColumns({"gate": F.col("ok"), "fault": fault}).withColumn("t", F.col("t") / DAY)
    return rounded(live.events(s, "user_id", "t", ["gate", "fault"], live.FormState, live.form_step), "t", "value", digits=6)


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as labels of two joints, and the next vector as the pose."""
    v = vectors(spark, sf_dir).withColumn("clip_id", F.floor(F.col("vec_id") / 50).cast("bigint"))
    joints = F.explode(F.array(*(F.struct(F.lit(j).alias("joint"), F.col(x).alias("x"), F.col(y).alias("y")) for j, x, y in (("wrist", "a", "b"), ("ankle", "c", "d")))))
    gt = v.select("clip_id", F.col("vec_id").alias("frame_idx"), joints.alias("p"), F.lit(2.0).alias("length")).select("clip_id", "frame_idx", "p.*", "length")
    pose = v.select((F.col("vec_id") - 1).alias("frame_idx"), joints.alias("p"), F.abs("a").alias("score")).select("frame_idx", "p.*", "score")
    return gt, pose


GT = f"""{VECTORS}, j AS (SELECT vec_id, 'wrist' AS joint, a AS x, b AS y, abs(a) AS score FROM v UNION ALL SELECT vec_id, 'ankle', c, d, abs(a) FROM v),
er AS (SELECT floor(g.vec_id / 50)::BIGINT AS clip_id, g.vec_id AS frame_idx, g.joint, p.score, p.x IS NOT NULL AS has_pred, sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2) / 2 AS error FROM j g LEFT JOIN j p ON p.vec_id = g.vec_id + 1 AND p.joint = g.joint)"""


@query(f", {GT} SELECT frame_idx, joint, has_pred, round(error, 5) AS error FROM er")
def joint_errors(spark, sf_dir):
    gt, pose = labelled(spark, sf_dir)
    return rounded(comparison.joint_errors(gt, pose, ["frame_idx"], "length").select("frame_idx", "joint", "has_pred", "error"), "error", digits=5)


@query(f""", {GT}, dl AS (SELECT *, CASE WHEN has_pred AND score >= 0.05 THEN error END AS d FROM er)
SELECT joint, clip_id, round(avg(coalesce(d <= 0.05, false)::INT), 6) AS pck005, round(avg(coalesce(d <= 0.1, false)::INT), 6) AS pck01, round(avg((d IS NULL)::INT), 6) AS miss_rate, round(avg(d), 5) AS mean_error, round(median(d), 5) AS median_error,
  count(DISTINCT frame_idx) AS n_frames, count(DISTINCT clip_id) AS n_clips FROM dl GROUP BY GROUPING SETS ((joint, clip_id), (joint), ())""")
def model_metrics(spark, sf_dir):
    gt, pose = labelled(spark, sf_dir)
    found = comparison.metrics(comparison.joint_errors(gt, pose, ["frame_idx"], "length"), [["joint", "clip_id"], ["joint"], []], 0.05, (0.05, 0.1))
    return rounded(rounded(found, "mean_error", "median_error", digits=5), "pck005", "pck01", "miss_rate", digits=6)


@query(f""", {DURATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, vis > 0.8 ORDER BY t, event_id) AS run FROM d),
s AS (SELECT user_id, vis > 0.8 AS c, run, sum(duration) AS q FROM r GROUP BY ALL)
SELECT user_id, count(*) AS frames, count(*) FILTER (x > 50) AS second_person_frames, round(coalesce(sum(duration) FILTER (x > 50), 0), 3) AS second_person_time, count(*) FILTER (vis > 0.8) AS contact_frames, count(*) FILTER (ok) AS athlete_frames,
  round((SELECT coalesce(max(q) FILTER (c), 0) FROM s WHERE s.user_id = d.user_id), 3) AS longest_contact, coalesce(sum(duration) FILTER (x > 50), 0) >= {DAY} AS trainer_present FROM d GROUP BY user_id""")
def clip_report(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"second": F.col("x") > 50, "touch": F.col("vis") > 0.8})
    return rounded(reports.clip_report(s, KEYS, "t", "event_id", "second", "touch", "ok", DAY), "second_person_time", "longest_contact", digits=3)


REPORTED = f"""WITH c AS ({ORACLE_SQL['clip_report']}), m AS (SELECT *, user_id AS clip_id, CASE WHEN user_id % 7 = 3 THEN 'no pose' END AS error, frames - athlete_frames AS dropped_frames, greatest(athlete_frames - contact_frames, 0) AS scorable_frames FROM c),
f AS (SELECT *, 100.0 * contact_frames / frames AS share FROM m WHERE error IS NULL)"""


def reported(spark, sf_dir):
    """Every seventh user's clip could not be read."""
    scorable = F.greatest(F.col("athlete_frames") - F.col("contact_frames"), F.lit(0))
    error = F.when(F.col("user_id") % 7 == 3, "no pose")
    return clip_report(spark, sf_dir).withColumns({"clip_id": F.col("user_id"), "error": error, "dropped_frames": F.col("frames") - F.col("athlete_frames"), "scorable_frames": scorable, "seconds": F.col("second_person_time")})


def dataset_report(spark, sf_dir):
    return rounded(reports.dataset_report(reported(spark, sf_dir)), "seconds", *(f"pct_{c}" for c in ("with_trainer", "clean", "second_person", "contact", "dropped", "scorable")), digits=3)


def report_clips(spark, sf_dir):
    return rounded(reports.report_clips(reported(spark, sf_dir)), "pct_contact")


QUERIES |= {"dataset_report": dataset_report, "report_clips": report_clips}
_PCT = lambda n, d: f"round(CASE WHEN {d} > 0 THEN 100.0 * {n} / {d} ELSE 0 END, 3)"
ORACLE_SQL["dataset_report"] = f"""{REPORTED}, t AS (SELECT (SELECT count(*) FROM m) AS clips, count(*) AS measured, (SELECT count(*) FROM m WHERE error IS NOT NULL) AS failed, count(*) FILTER (trainer_present) AS with_trainer, count(*) FILTER (NOT trainer_present) AS clean,
  coalesce(sum(second_person_time), 0) AS seconds, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in ('frames', 'second_person_frames', 'contact_frames', 'dropped_frames', 'scorable_frames'))} FROM f)
SELECT * EXCLUDE (seconds), round(seconds, 3) AS seconds, {_PCT('with_trainer', 'measured')} AS pct_with_trainer, {_PCT('clean', 'measured')} AS pct_clean, {', '.join(f"{_PCT(f'{c}_frames', 'frames')} AS pct_{c}" for c in ('second_person', 'contact', 'dropped', 'scorable'))} FROM t"""
ORACLE_SQL["report_clips"] = f"""{REPORTED} SELECT * FROM (SELECT clip_id, 'affected' AS why, round(share, 4) AS pct_contact, NULL::VARCHAR AS error FROM f ORDER BY share DESC, longest_contact DESC, clip_id LIMIT 10) UNION ALL SELECT clip_id, 'failed', NULL, error FROM m WHERE error IS NOT NULL"""


@query("""SELECT user_id, count(*) AS compared, count(*) FILTER ((vis > 0.5) <> (y > 25) AND (x > 50) = (y > 25)) AS fixed, count(*) FILTER ((vis > 0.5) = (y > 25) AND (x > 50) <> (y > 25)) AS broken FROM e WHERE x IS NOT NULL AND vis IS NOT NULL GROUP BY user_id""")
def compare_readings(spark, sf_dir):
    s = series(spark, sf_dir)
    return reports.compare_readings(s, KEYS, F.col("vis") > 0.5, F.col("x") > 50, F.col("y") > 25)


@query("SELECT user_id, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) ELSE 'mixed' END AS skill FROM e WHERE event_type <> 'error' GROUP BY user_id")
def clip_skills(spark, sf_dir):
    return reports.clip_skills(series(spark, sf_dir), "user_id", "event_type", ("error",))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (date_trunc('week', to_timestamp(t) AT TIME ZONE 'UTC') = date_trunc('week', (SELECT max(ts) FROM events))) AS this_week, round(max(x), 4) AS best FROM e GROUP BY user_id""")
def session_progress(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    now = ev.agg(F.max("ts")).first()[0]  # one time
    return rounded(reports.progress(ev, "user_id", "ts", "value", F.lit(now)).select("user_id", "total", "this_week", "best"), "best")


@query()
def clip_diagnostics(spark, sf_dir):
    return reports.diagnostics(series(spark, sf_dir), KEYS, "t", "event_type")
