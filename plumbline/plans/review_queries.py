"""Queries of matching, orientation, reviews and roll-ups over the provided tables, and the SQL that checks them.

An order stands for a frame and its line items for the people in it; a supplier for a clip and an order's part in it
for a hold; a user's events for a clip's frames. Importing this module adds to the queries of ``plans.queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import matching, people, review, runs
from plumbline.plans.queries import KEYS, ORACLE_SQL, ORDER, RECURSIVE, query, rounded, series, table

CROWD = """, p AS (SELECT l_orderkey AS frame, l_linenumber AS person, l_suppkey AS clip, CASE WHEN l_returnflag <> 'R' THEN l_quantity::DOUBLE END AS lw, l_extendedprice::DOUBLE / 2000 AS rw, l_discount::DOUBLE * 500 AS la,
  CASE WHEN l_linestatus = 'F' THEN l_tax::DOUBLE * 600 END AS ra, l_tax::DOUBLE AS score, l_quantity::DOUBLE AS x0, l_extendedprice::DOUBLE / 2000 AS y0 FROM lineitem),
q AS (SELECT *, (coalesce((lw + rw) / 2, lw, rw) > coalesce((la + ra) / 2, la, ra)) AS inverted, abs(lw - la) / 50 AS gap FROM p)"""


def crowd(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    p = li.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("person"), F.col("l_suppkey").alias("clip"), F.when(F.col("l_returnflag") != "R", d("l_quantity")).alias("lw"), (d("l_extendedprice") / 2000).alias("rw"),
        (d("l_discount") * 500).alias("la"), F.when(F.col("l_linestatus") == "F", d("l_tax") * 600).alias("ra"), d("l_tax").alias("score"), d("l_quantity").alias("x0"), (d("l_extendedprice") / 2000).alias("y0"),
    )
    return p.withColumn("inverted", matching.tri_state_inverted(*(F.col(c) for c in ("lw", "rw", "la", "ra")))).withColumn("gap", F.abs(F.col("lw") - F.col("la")) / 50)


@query(f"{CROWD} SELECT frame, person, inverted, coalesce(inverted, false) AS hold_like, round((lw + rw) / 2, 6) AS wrist_y FROM q")
def way_up(spark, sf_dir):
    p = crowd(spark, sf_dir)
    both = p.select("frame", "person", "inverted", matching.hold_like(*(F.col(c) for c in ("lw", "rw", "la", "ra"))).alias("hold_like"), matching.both_mean(F.col("lw"), F.col("rw")).alias("wrist_y"))
    return rounded(both, "wrist_y", digits=6)


@query(f"{CROWD} SELECT frame, person, score FROM q QUALIFY row_number() OVER (PARTITION BY frame ORDER BY coalesce(inverted, false) DESC, score DESC, person) = 1")
def inverted_first(spark, sf_dir):
    return matching.inverted_first(crowd(spark, sf_dir), ["frame"], "person", "inverted", "score").select("frame", "person", "score")


_IOU = "greatest(0, 10 - abs(q.x0 - r.x0)) * greatest(0, 10 - abs(q.y0 - r.y0))"


@query(f"""{CROWD}, r AS (SELECT l_orderkey AS frame, min(l_quantity)::DOUBLE AS x0, max(l_extendedprice)::DOUBLE / 2000 AS y0, max(l_discount) < 0.08 AS length_ok, CASE WHEN max(l_tax) > 0.03 THEN false END AS r_inverted FROM lineitem GROUP BY 1),
j AS (SELECT q.frame, q.person, q.score, q.gap, coalesce(length_ok, false) AS m, ({_IOU}) / (200 - ({_IOU})) AS o, q.inverted, r_inverted FROM q JOIN r USING (frame)),
k AS (SELECT frame, bool_and(m) AS m, arg_min(person, (coalesce(gap, 1e9), -o, person)) AS near, min(coalesce(gap, 1e9)) AS gap, arg_min(person, (-o, person)) FILTER (coalesce(NOT r_inverted, false) AND coalesce(inverted, false) AND o > 0.1) AS fb, arg_min(person, (-score, person)) AS sure FROM j GROUP BY frame)
SELECT frame, CASE WHEN NOT m THEN sure WHEN gap <= 0.35 THEN near ELSE fb END AS person, CASE WHEN NOT m THEN 'confidence' WHEN gap <= 0.35 THEN 'keypoint_gap' WHEN fb IS NOT NULL THEN 'orientation_fallback' ELSE 'none' END AS rule FROM k""")
def matched_person(spark, sf_dir):
    box = lambda x, y: F.struct(x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    persons = crowd(spark, sf_dir).withColumn("box", box(F.col("x0"), F.col("y0")))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(
        F.min("l_quantity").cast("double").alias("x"), (F.max("l_extendedprice").cast("double") / 2000).alias("y"), F.when(F.max("l_discount") < 0.08, F.lit(80.0)).alias("r_length"), F.when(F.max("l_tax") > 0.03, F.lit(False)).alias("r_inverted")
    )
    references = li.select("frame", box(F.col("x"), F.col("y")).alias("r_box"), "r_length", "r_inverted")
    return matching.match_reference(persons, references, ["frame"], "person")


@query()
def without_twins(spark, sf_dir):
    p = crowd(spark, sf_dir).groupBy("frame", "person").agg(F.max("score").alias("score"), F.min("x0").alias("x0"))
    a, b = p.alias("a"), p.alias("b")
    near = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.person") < F.col("b.person")) & (F.abs(F.col("a.x0") - F.col("b.x0")) <= 12)
    pairs = a.join(b, near).select("a.frame", F.col("a.person").alias("a"), F.col("b.person").alias("b"))
    return matching.without_twins(p, pairs, ["frame"], "person", "score").select("frame", F.col("person").cast("bigint").alias("person"))


ORACLE_SQL["without_twins"] = f"""{RECURSIVE}{CROWD}, u AS (SELECT frame, person, max(score) AS score, min(x0) AS x0 FROM q GROUP BY 1, 2), n AS (SELECT frame, person, score, row_number() OVER (PARTITION BY frame ORDER BY person) AS i FROM u),
pair AS (SELECT a.frame, a.person AS a, b.person AS b FROM u a JOIN u b ON a.frame = b.frame AND a.person < b.person AND abs(a.x0 - b.x0) <= 12),
f AS (SELECT frame, 0::BIGINT AS i, []::INTEGER[] AS kept, []::DOUBLE[] AS vis FROM n WHERE i = 1
  UNION ALL SELECT f.frame, f.i + 1, CASE WHEN t IS NULL THEN list_append(kept, n.person::INTEGER) WHEN n.score > vis[t] THEN list_concat(list_append(kept[1:t - 1], n.person::INTEGER), kept[t + 1:]) ELSE kept END,
    CASE WHEN t IS NULL THEN list_append(vis, n.score) WHEN n.score > vis[t] THEN list_concat(list_append(vis[1:t - 1], n.score), vis[t + 1:]) ELSE vis END
  FROM f JOIN n ON n.frame = f.frame AND n.i = f.i + 1, LATERAL (SELECT min(g.k) AS t FROM (SELECT unnest(range(1, len(f.kept) + 1)) AS k) g JOIN pair ON pair.frame = f.frame AND pair.a = least(f.kept[g.k], n.person) AND pair.b = greatest(f.kept[g.k], n.person)) x)
SELECT frame, unnest(kept)::BIGINT AS person FROM (SELECT frame, arg_max(kept, i) AS kept FROM f GROUP BY frame)"""


@query(f"""{CROWD} SELECT frame, min(clip) AS clip, bool_or(score > 0.02) AS detected, bool_or(la > 40) AS rotated, round(arg_min(rw, (-rw, person)), 6) AS wrist_y, round(arg_min(la, (-rw, person)), 6) AS ankle_y, coalesce(arg_min(rw, (-rw, person)) > arg_min(la, (-rw, person)), false) AS inverted
FROM q GROUP BY frame""")
def frame_reads(spark, sf_dir):
    p = crowd(spark, sf_dir).withColumns({"d": F.col("score") > 0.02, "r": F.col("la") > 40, "wrist_y": F.col("rw"), "ankle_y": F.col("la")})
    return rounded(matching.frame_reads(p, ["frame"], "clip", "person", "d", "r"), "wrist_y", "ankle_y", digits=6)


def binary_rounded(df, *columns, digits=4):
    """``rounded`` as the SQL does it: the nearest whole number of scaled doubles, halves away from 0, where ``round`` takes the decimals a double is printed with."""
    scale = float(10**digits)
    for c in columns:
        size = F.abs(F.col(c) * scale)
        whole = F.floor(size).cast("double")
        # from 2 ** 52 on a double has no decimals
        near = F.when(size < 2.0**52, whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(size)
        df = df.withColumn(c, F.signum(c) * near / scale)
    return df


@query(f"""{CROWD} SELECT frame, person, round(CASE WHEN sqrt(dx * dx + dy * dy) > 0 THEN sqrt(dx * dx + dy * dy) END, 4) AS torso, round(sqrt((lw - la) * (lw - la) + (rw - la) * (rw - la)) / CASE WHEN sqrt(dx * dx + dy * dy) > 0 THEN sqrt(dx * dx + dy * dy) END, 4) AS error,
  round(coalesce(CASE WHEN lw > 20 THEN lw END, CASE WHEN rw > 20 THEN rw END), 6) AS unit, round(la - lw, 6) AS margin FROM (SELECT *, coalesce((lw + ra) / 2, lw, ra) - la AS dx, CASE WHEN lw IS NULL AND ra IS NULL THEN NULL ELSE rw - score END AS dy FROM q)""")
def torso_units(spark, sf_dir):
    p = crowd(spark, sf_dir)
    at = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    c = F.col
    torso = matching.torso_length(at(c("lw"), c("rw")), at(c("ra"), c("rw")), at(c("la"), c("score")), F.lit(None).cast("struct<x:double,y:double>"))
    out = p.select("frame", "person", torso.alias("torso"), matching.normalised_error(at(c("lw"), c("rw")), at(c("la"), c("la")), torso).alias("error"), matching.disagreement_unit(c("lw"), c("rw"), 20.0).alias("unit"), matching.frame_margin(c("lw"), c("la")).alias("margin"))
    return rounded(binary_rounded(out, "torso", "error"), "unit", "margin", digits=6)


@query("""SELECT user_id, coalesce(avg(vis - 0.5) > 0, false) AS opens_rotated FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM e) WHERE t <= t0 + 0.5 GROUP BY user_id""")
def opening_orientation(spark, sf_dir):
    return matching.opening_orientation(series(spark, sf_dir).withColumn("margin", F.col("vis") - 0.5), KEYS, "t", "margin")


@query("SELECT event_id, coalesce(last_value(CASE WHEN ok THEN x > 50 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rotate FROM e")
def rotate_next(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("inverted", F.col("x") > 50)
    return matching.rotate_next(s, KEYS, ORDER, "inverted", "ok").select("event_id", "rotate")


@query(f"{CROWD} SELECT frame, avg(score) AS visibility FROM q WHERE person IN (1, 2, 3) GROUP BY frame")
def main_visibility(spark, sf_dir):
    return matching.mean_visibility(crowd(spark, sf_dir), ["frame"], (1, 2, 3), "person", "score")


@query(f"""{CROWD} SELECT frame, person, score > 0.02 AS own FROM q WHERE frame IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND person >= 0""")
def pool_of_frames(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("frame"))
    p = crowd(spark, sf_dir).withColumn("own", F.col("score") > 0.02)
    chosen = matching.model_person(p, wanted, ["frame"], "own")
    rest = matching.pool(p.where("NOT own"), wanted, ["frame"], "person")
    return chosen.unionByName(rest).select("frame", "person", "own")


HOLD = """, h AS (SELECT l_suppkey AS clip, l_orderkey AS hold, min(['AIR', 'SHIP', 'RAIL', 'MAIL', 'FOB'][l_partkey % 5 + 1]) AS mode, min(l_returnflag) AS flag, sum(l_quantity)::DOUBLE AS duration, max(l_extendedprice)::DOUBLE AS score FROM lineitem GROUP BY 1, 2),
a AS (SELECT s_suppkey AS clip, CASE s_suppkey % 4 WHEN 0 THEN ' Side ' WHEN 1 THEN '' WHEN 2 THEN 'front' END AS angle FROM supplier),
v AS (SELECT clip, hold, CASE WHEN mode IN ('AIR', 'SHIP') THEN 'side' WHEN mode = 'RAIL' THEN 'not_side' ELSE 'unclear' END AS view FROM h WHERE flag <> 'A')"""


def mode_of():
    return F.element_at(F.array(*map(F.lit, ("AIR", "SHIP", "RAIL", "MAIL", "FOB"))), (F.col("l_partkey") % 5 + 1).cast("int"))


def holds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    h = li.groupBy(F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("hold")).agg(F.min(mode_of()).alias("mode"), F.min("l_returnflag").alias("flag"), F.sum("l_quantity").cast("double").alias("duration"), F.max("l_extendedprice").cast("double").alias("score"))
    k = F.col("s_suppkey") % 4
    angles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), F.when(k == 0, " Side ").when(k == 1, "").when(k == 2, "front").alias("angle"))
    view = F.when(F.col("mode").isin("AIR", "SHIP"), "side").when(F.col("mode") == "RAIL", "not_side").otherwise("unclear")
    return h, angles, h.where("flag <> 'A'").select("clip", "hold", view.alias("view"))


@query(f"""{HOLD}, j AS (SELECT h.clip, h.hold, lower(trim(coalesce(angle, ''))) AS angle, view FROM h LEFT JOIN a USING (clip) LEFT JOIN v ON v.clip = h.clip AND v.hold = h.hold),
k AS (SELECT *, CASE WHEN angle = '' THEN coalesce(view = 'side', false) ELSE angle = 'side' END AS is_side FROM j)
SELECT clip, hold, is_side, CASE WHEN is_side THEN '' ELSE clip || ' h' || hold || ': not side view (camera_angle=' || CASE WHEN angle = '' THEN 'empty, detected=' || coalesce(view, 'none') ELSE angle END || ')' END AS note FROM k""")
def side_views(spark, sf_dir):
    h, angles, views = holds(spark, sf_dir)
    return review.side_views(h, angles, views, "clip", "hold").select("clip", "hold", "is_side", "note")


@query(f"""{HOLD} SELECT h.clip, h.hold, CASE WHEN coalesce(angle, '') <> '' THEN angle = 'front' AND false ELSE coalesce(CASE WHEN mode = 'AIR' THEN 'side' ELSE view END = 'side', false) END AS is_side
FROM h LEFT JOIN a USING (clip) LEFT JOIN v ON v.clip = h.clip AND v.hold = h.hold""")
def side_windows(spark, sf_dir):
    h, angles, views = holds(spark, sf_dir)
    both = h.join(angles, "clip", "left").join(views, ["clip", "hold"], "left")
    origin = F.when(F.col("mode") == "AIR", "segment").otherwise("hold")
    return both.select("clip", "hold", review.is_side_window(F.col("angle"), origin, F.lit("side"), F.col("view")).alias("is_side"))


@query(f"""{HOLD}, s AS (SELECT h.*, coalesce(view = 'not_side', false) AS other FROM h LEFT JOIN v USING (clip, hold) WHERE score > 20000)
SELECT clip, arg_min(score, (-duration, hold)) FILTER (NOT other) AS side_score, bool_and(other) AS not_side_only FROM s GROUP BY clip""")
def side_scores(spark, sf_dir):
    h, _, views = holds(spark, sf_dir)
    return review.side_scores(h.withColumn("score", F.when(F.col("score") > 20000, F.col("score"))), views, "clip", "hold", "duration", "score")


@query(f"""{HOLD}, l AS (SELECT clip, hold, CASE WHEN mode = 'MAIL' THEN 'line' ELSE 'tuck' END AS shape FROM h WHERE flag = 'N')
SELECT h.clip, h.hold, coalesce(shape = 'line', false) AS is_line, coalesce(flag = 'N' AND mode <> 'FOB', false) AS reviewed FROM h LEFT JOIN l USING (clip, hold)""")
def line_holds(spark, sf_dir):
    h, _, _ = holds(spark, sf_dir)
    shapes = h.where("flag = 'N'").select("clip", F.col("hold").cast("string").alias("hold"), F.when(F.col("mode") == "MAIL", "line").otherwise("tuck").alias("shape"))
    shapes = review.keyed_shapes(shapes.unionByName(shapes.limit(1).withColumn("hold", F.lit("not a number"))), ["clip", "hold"])
    out = review.line_flag(h, shapes, ["clip", "hold"])
    only = review.line_holds(h, shapes, ["clip", "hold"]).select("clip", "hold", F.lit(True).alias("_line"))
    good = review.reference_holds(h.withColumns({"ok": F.col("flag") == "N", "wall": F.col("mode") == "FOB"}), "ok", "wall").select("clip", "hold", F.lit(True).alias("_good"))
    out = out.join(only, ["clip", "hold"], "left").join(good, ["clip", "hold"], "left")
    return out.select("clip", "hold", (F.col("is_line") & F.col("_line").isNotNull()).alias("is_line"), F.col("_good").isNotNull().alias("reviewed"))


FRAMES = """, g AS (SELECT user_id, event_id, t, x, y, ok, CASE WHEN event_type <> 'view' THEN event_type END AS hold FROM e)"""


def hold_frames(spark, sf_dir):
    return series(spark, sf_dir).withColumn("hold", F.when(F.col("event_type") != "view", F.col("event_type")))


@query(f"""{FRAMES}, d AS (SELECT user_id, hold, count(*) AS n, count(*) FILTER (ok) AS nv, max(t) - min(t) AS span, quantile_cont(x, 0.5) FILTER (ok) AS m FROM g GROUP BY 1, 2)
SELECT user_id, sum(n)::BIGINT AS frames, sum(nv)::BIGINT AS valid_frames, count(*) FILTER (hold IS NOT NULL) AS hold_count, coalesce(sum(n) FILTER (hold IS NOT NULL), 0)::BIGINT AS hold_frames, coalesce(sum(nv) FILTER (hold IS NOT NULL), 0)::BIGINT AS measured_hold_frames,
  arg_min(hold, (-span, hold)) FILTER (hold IS NOT NULL) AS longest_hold, round(coalesce(max(span) FILTER (hold IS NOT NULL), 0), 3) AS longest_s, round(arg_min(coalesce(m, -1), (-span, hold)) FILTER (hold IS NOT NULL), 4) AS longest_median FROM d GROUP BY user_id""")
def clip_stats(spark, sf_dir):
    stats = review.clip_stats(hold_frames(spark, sf_dir), "user_id", "hold", "t", "ok", "x")
    stats = stats.withColumn("longest_median", F.when(F.col("longest_hold").isNotNull(), F.coalesce("longest_median", F.lit(-1.0))))
    return rounded(rounded(stats, "longest_s", digits=3), "longest_median")


@query(f"{FRAMES} SELECT user_id, hold, round(max(t) - min(t), 3) AS duration, count(*) FILTER (ok) AS measurable FROM g WHERE hold IS NOT NULL GROUP BY 1, 2")
def hold_durations(spark, sf_dir):
    g = hold_frames(spark, sf_dir)
    spans = review.hold_durations(g, KEYS, "hold", "t")
    counts = g.where("hold IS NOT NULL").groupBy(*KEYS, "hold").agg(F.count_if(review.measurable(F.col("hold"), F.col("ok"))).alias("measurable"))
    return rounded(spans.join(counts, [*KEYS, "hold"]), "duration", digits=3)


@query(f"""{FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY t, event_id) AS k FROM g),
s AS (SELECT user_id, ok AS shape, min(t) AS a, max(t) AS b FROM r GROUP BY user_id, ok, k), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS segment_id, count(*) OVER (PARTITION BY user_id) > 1 AS mixed FROM s)
SELECT w.user_id, segment_id, shape, mixed, count(g.t) AS segment_frames, count(*) FILTER (g.ok) AS valid_frames, round(quantile_cont(x, 0.5) FILTER (g.ok), 4) AS x_median, round((quantile_cont(x, 0.75) FILTER (g.ok)) - (quantile_cont(x, 0.25) FILTER (g.ok)), 4) AS x_iqr, round(b - a, 3) AS duration
FROM w JOIN g ON g.user_id = w.user_id AND g.t BETWEEN a AND b GROUP BY w.user_id, segment_id, shape, mixed, a, b""")
def segment_stats(spark, sf_dir):
    from pyspark.sql import Window

    g = hold_frames(spark, sf_dir)
    marked = runs.run_ids(g, KEYS, ORDER, F.col("ok"))
    segments = marked.groupBy(*KEYS, "run", F.col("ok").alias("shape")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    segments = segments.withColumn("segment_id", F.row_number().over(Window.partitionBy(*KEYS).orderBy("start", "end")).cast("bigint")).drop("run")
    found = review.segment_stats(segments, g, KEYS, "t", "ok", ["x"]).drop("start", "end")
    return rounded(rounded(found, "duration", digits=3), "x_median", "x_iqr")


@query(f"""{HOLD}, w AS (SELECT clip, hold, mode AS shape, count(*) OVER (PARTITION BY clip) > 2 AS mixed, duration FROM h), l AS (SELECT clip, hold, CASE WHEN flag = 'A' THEN mode ELSE 'AIR' END AS reviewed FROM h WHERE flag <> 'N')
SELECT shape, count(*) AS segments, count(*) FILTER (mixed) AS mixed, round(sum(duration), 3) AS seconds, count(reviewed) AS reviewed, count(*) FILTER (reviewed = shape) AS agreed FROM w LEFT JOIN l USING (clip, hold) GROUP BY shape""")
def segment_report(spark, sf_dir):
    from pyspark.sql import Window

    h, _, _ = holds(spark, sf_dir)
    segments = h.select("clip", "hold", F.col("mode").alias("shape"), (F.count(F.lit(1)).over(Window.partitionBy("clip")) > 2).alias("mixed"), "duration")
    labels = h.where("flag <> 'N'").select("clip", "hold", F.when(F.col("flag") == "A", F.col("mode")).otherwise("AIR").alias("shape"))
    return rounded(review.segment_report(segments, labels, ["clip", "hold"]), "seconds", digits=3)


@query(f"""{HOLD}, b AS (SELECT 'best' AS "end", row_number() OVER (ORDER BY score DESC, clip, hold) AS place, clip, hold, score FROM h), w AS (SELECT 'worst' AS "end", row_number() OVER (ORDER BY score, clip, hold) AS place, clip, hold, score FROM h)
SELECT * FROM b WHERE place <= 5 UNION ALL SELECT * FROM w WHERE place <= 5""")
def best_and_worst(spark, sf_dir):
    h, _, _ = holds(spark, sf_dir)
    return review.extremes(h.select("clip", "hold", "score"), "score", ["clip", "hold"])


@query(f"{HOLD} SELECT clip, hold, round(abs(score - 30000), 2) AS off FROM h ORDER BY abs(score - 30000) DESC, clip, hold LIMIT 10")
def most_affected(spark, sf_dir):
    h, _, _ = holds(spark, sf_dir)
    top = review.ranked(h.withColumn("off", F.col("score") - 30000), "off", ["clip", "hold"], 10, absolute=True)
    return rounded(top.select("clip", "hold", F.abs("off").alias("off")), "off", digits=2)


@query("SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN abs(x) > 60 WHEN 'click' THEN x < 30 ELSE x > 90 END, false) AS fails FROM e")
def failed_targets(spark, sf_dir):
    s = series(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "either").when(F.col("event_type") == "click", "below").otherwise("above")
    target = F.when(kind == "either", 60).when(kind == "below", 30).otherwise(90)
    return s.select("event_id", review.fails_tolerance(F.col("x"), target, kind).alias("fails"))


_SIDE_SQL = "CASE WHEN {c} > {hi} THEN 'left' WHEN {c} < {lo} THEN 'right' END"


@query(f"""{CROWD}, s AS (SELECT frame, person, clip, {_SIDE_SQL.format(c='x0', hi=30, lo=20)} AS human, {_SIDE_SQL.format(c='y0', hi=15, lo=10)} AS rule, {_SIDE_SQL.format(c='score', hi=0.05, lo=0.03)} AS vis, {_SIDE_SQL.format(c='la', hi=30, lo=20)} AS z FROM q)
SELECT clip, count(*) AS frames, CASE WHEN count(rule) > 0 THEN CASE WHEN count(*) FILTER (rule = 'left') >= count(*) FILTER (rule = 'right') THEN 'left' ELSE 'right' END END AS rule_side, least(count(*) FILTER (rule = 'left'), count(*) FILTER (rule = 'right')) AS rule_against,
  CASE WHEN count(z) > 0 THEN CASE WHEN count(*) FILTER (z = 'left') >= count(*) FILTER (z = 'right') THEN 'left' ELSE 'right' END END AS z_side, least(count(*) FILTER (z = 'left'), count(*) FILTER (z = 'right')) AS z_against,
  count(*) FILTER (vis = human) AS vis_agrees, count(*) FILTER (z = human) AS z_agrees FROM s GROUP BY clip""")
def hold_sides(spark, sf_dir):
    side = lambda c, hi, lo: F.when(F.col(c) > hi, "left").when(F.col(c) < lo, "right")
    read = review.label_sides(crowd(spark, sf_dir), ["clip", "frame", "person"], side("x0", 30, 20), side("y0", 15, 10), side("score", 0.05, 0.03), side("la", 30, 20))
    counts = read.groupBy("clip").agg(F.count_if("vis_agrees").alias("vis_agrees"), F.count_if("z_agrees").alias("z_agrees"))
    return review.hold_sides(read, ["clip"], ["rule", "z"]).join(counts, "clip")


@query("""SELECT l_orderkey AS frame, CASE WHEN bool_or(l_partkey % 5 = 2) AND NOT bool_or(l_partkey % 5 = 3) THEN 'left' WHEN bool_or(l_partkey % 5 = 3) AND NOT bool_or(l_partkey % 5 = 2) THEN 'right' END AS side FROM lineitem GROUP BY 1""")
def labelled_side(spark, sf_dir):
    mode = mode_of()
    joint = F.when(mode.startswith("R"), F.concat(F.lit("left_"), mode)).when(mode.startswith("M"), F.concat(F.lit("right_"), mode)).otherwise(mode)
    return review.labelled_side(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), joint.alias("joint")), ["frame"])


@query("""SELECT clip, frame, image, n_joints, human, missing_clip, human AND NOT missing_clip AS keep, coalesce(stratum, 'none') AS stratum FROM (SELECT l_suppkey AS clip, l_orderkey AS frame, l_suppkey || '_' || l_orderkey || '.jpg' AS image, count(*) AS n_joints, l_suppkey % 5 = 0 AS missing_clip FROM lineitem GROUP BY 1, 2) f
LEFT JOIN (SELECT o_orderkey, o_orderpriority AS stratum, o_orderstatus <> 'F' AS human FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = frame WHERE human IS NOT NULL""")
def labelled_frames(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("frame"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), "o_orderstatus", F.col("o_orderpriority").alias("stratum"))
    li = li.join(orders.where("o_orderstatus <> 'P'").select("frame"), "frame", "left_semi")
    machine = li.join(orders.where("o_orderstatus = 'F'").select("frame"), "frame", "left_semi").select(F.concat(F.col("clip").cast("string"), F.lit("_"), F.col("frame").cast("string"), F.lit(".jpg")).alias("image"))
    missing = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("clip"))
    frames = review.labelled_frames(li, "clip", "frame", machine, missing)
    return review.annotated_frames(frames, [(orders.where("o_orderstatus <> 'P'"), ["frame"], {"stratum": "none"})])


@query("""SELECT count(*) AS clips, sum(n)::BIGINT AS compared, sum(f)::BIGINT AS fixed, sum(b)::BIGINT AS broken, count(*) FILTER (m > 0) AS better, count(*) FILTER (m < 0) AS worse, count(*) FILTER (m = 0) AS unchanged, count(*) FILTER (abs(m) > 10) AS moved_ten_points, round(100.0 * sum(i) / sum(n), 4) AS inverted_percent
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (x > 50) AS f, count(*) FILTER (x < 20) AS b, count(*) FILTER (ok) AS i, count(*) FILTER (x > 50)::BIGINT - count(*) FILTER (x < 45)::BIGINT AS m FROM e GROUP BY user_id)""")
def comparison_snapshot(spark, sf_dir):
    rows = series(spark, sf_dir).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("x") > 50).alias("fixed"), F.count_if(F.col("x") < 20).alias("broken"), F.count_if("ok").alias("inverted"), F.count(F.lit(1)).alias("detected"), (F.count_if(F.col("x") > 50) - F.count_if(F.col("x") < 45)).alias("moved")
    )
    return rounded(review.snapshot(rows), "inverted_percent")


@query(f"""{HOLD}, c AS (SELECT s_suppkey AS clip, s_acctbal > 0 AS usable, s_nationkey AS frames, s_nationkey > 12 AS trainer FROM supplier)
SELECT u.*, w.* FROM (SELECT count(*) FILTER (usable) AS usable_clips, sum(frames) FILTER (usable)::BIGINT AS frames, count(*) FILTER (trainer) AS trainer_clips FROM c) u, (SELECT count(DISTINCT clip) AS hold_clips, round(sum(duration), 3) AS hold_s FROM h) w""")
def chain_snapshot(spark, sf_dir):
    clips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), (F.col("s_acctbal") > 0).alias("usable"), F.col("s_nationkey").alias("frames"), (F.col("s_nationkey") > 12).alias("trainer"))
    return rounded(review.chain_snapshot(clips, holds(spark, sf_dir)[0], "usable", "frames", "trainer", "clip", "duration"), "hold_s", digits=3)


@query("""SELECT sum(n)::BIGINT AS total, sum(v)::BIGINT AS valid, round(100.0 * sum(v) / sum(n), 4) AS valid_percent, round(quantile_cont(j, 0.5), 4) AS jitter_median, round(quantile_cont(l, 0.5), 4) AS length_median, count(*) FILTER (l IS NULL) AS unusable
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS v, avg(x) FILTER (ok) AS j, CASE WHEN count(*) FILTER (ok) > 5 THEN max(y) END AS l FROM e GROUP BY user_id)""")
def cleaning_summary(spark, sf_dir):
    reports = series(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.avg(F.when(F.col("ok"), F.col("x"))).alias("jitter"), F.when(F.count_if("ok") > 5, F.max("y")).alias("length"))
    return rounded(review.cleaning_summary(reports), "valid_percent", "jitter_median", "length_median")


@query(f"""{HOLD}, n AS (SELECT clip, count(*) AS holds FROM h GROUP BY clip) SELECT s_suppkey AS clip, coalesce(holds, 0) AS holds, CASE WHEN s_suppkey % 3 = 0 THEN 'good; several people' WHEN s_suppkey % 3 = 1 THEN 'several people' ELSE '' END AS notes FROM supplier LEFT JOIN n ON clip = s_suppkey""")
def flagged_clips(spark, sf_dir):
    clips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"))
    k = F.col("clip") % 3
    catalogue = clips.withColumn("notes", F.when(k == 0, "good").when(k == 1, "several people"))
    flagged = review.flag_clips(catalogue, clips.where("clip % 3 < 2"), "clip", "notes", "several people")
    return review.holds_per_clip(holds(spark, sf_dir)[0], clips, "clip").join(flagged, "clip")


@query("SELECT o_custkey AS image, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS frame FROM orders GROUP BY 1")
def image_index(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("frame"), "o_orderdate")
    return review.image_index(rows, "image", ["o_orderdate", "frame"]).select("image", "frame")
