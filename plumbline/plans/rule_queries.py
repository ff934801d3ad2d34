"""Rules on single values, the frame sampler, cues and whole-table statistics as queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import text
from plumbline.operators import ingest, reports, sampling, scoring
from plumbline.plans import pose, pose_queries
from plumbline.plans.pose_queries import checked
from plumbline.plans.queries import DAY, query, rounded, series, table
from plumbline.session import settled
from plumbline.streaming import cues


@query("""SELECT p_partkey, lower(trim(p_brand)) = 'true' AS said_true, (p_size % 2 = 0) AS flag, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR END, trim(p_name)) AS hold, CASE WHEN p_size % 2 = 0 THEN p_brand END AS clip, CASE WHEN p_size % 2 = 0 THEN p_partkey::BIGINT END AS frame,
  CASE WHEN p_size * 10 < 300 THEN [round_even(100 + p_size * 5.0, 0)::BIGINT] ELSE [round_even(100 + p_size * 2.5, 0)::BIGINT, round_even(100 + p_size * 5.0, 0)::BIGINT, round_even(100 + p_size * 7.5, 0)::BIGINT] END AS times,
  CASE WHEN p_size % 2 = 0 THEN p_name || ' take' || (p_size + 1) || '.mp4' ELSE p_name || '.mp4' END AS take, CASE WHEN p_size % 4 IN (1, 3) THEN p_partkey ELSE p_size END::BIGINT AS shown_width, CASE WHEN p_size % 4 IN (1, 3) THEN p_size ELSE p_partkey END::BIGINT AS shown_height,
  coalesce(abs(p_retailprice::DOUBLE - 1000) / 1000 > 0.005, false) AS variable, CASE p_size % 4 WHEN 0 THEN p_size > 10 WHEN 1 THEN p_size > 0 WHEN 2 THEN p_size <= 20 ELSE p_size <= 30 END AS visible FROM part""")
def text_rules(spark, sf_dir):
    """STR3-5, STR8, STR11, ING3, ING9, ING10, LAB5: a part's columns stand for what is written of a clip."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("long"), F.col("p_partkey").cast("long")
    even = size % 2 == 0
    image = text.parse_image_name(F.when(even, F.concat("p_brand", F.lit("_"), key.cast("string"), F.lit(".jpg"))).otherwise(F.concat("p_brand", F.lit("-x.png"))))
    shown = text.display_size(size, key, size % 4 * 90)
    only = lambda k, c: F.when(size % 4 == k, c)
    visible = text.keypoint_visible(only(0, size > 10), only(1, size.cast("double")), only(2, size > 20), only(3, size > 30))
    return p.select(
        "p_partkey", text.lenient_bool(F.col("p_brand")).alias("said_true"), text.strict_bool(F.when(even, F.lit(" TRUE")).otherwise("false"), "even").alias("flag"),
        text.hold_key(F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(".0"))).otherwise(F.col("p_name"))).alias("hold"), image["clip_id"].alias("clip"), image["frame_idx"].alias("frame"),
        text.segment_times(F.lit(100), size * 10 + 100).alias("times"), text.take_name(F.concat("p_name", F.when(even, F.concat(F.lit(" ("), size.cast("string"), F.lit(").mp4"))).otherwise(".mp4"))).alias("take"),
        shown["width"].alias("shown_width"), shown["height"].alias("shown_height"), text.variable_frame_rate(F.col("p_retailprice").cast("double"), F.lit(1000.0)).alias("variable"), visible.alias("visible"),
    )


_V = "embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE AS f, embedding[7]::DOUBLE AS g, embedding[8]::DOUBLE AS h"


def _across(ax: str, ay: str, bx: str, by: str) -> str:
    return f"abs(({bx} - {ax}) * dy - ({by} - {ay}) * dx) / size"


@query(f""", v AS (SELECT vec_id, {_V} FROM embeddings), w AS (SELECT *, (a + c) / 2 - (e + g) / 2 AS dx, (b + d) / 2 - (f + h) / 2 AS dy FROM v), x AS (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM w)
SELECT vec_id, round(a, 6) AS back_x, round(b, 6) AS back_y, round(a * 639, 5) AS pixel_x, round(b * 359, 5) AS pixel_y, round(c / 100 * 639, 6) AS percent_x, coalesce(a > b, false) AS inverted,
  round(CASE WHEN size > 1e-9 THEN ({_across('a', 'b', 'c', 'd')} + {_across('e', 'f', 'g', 'h')}) / 2 / 2 END, 5) AS width, CASE WHEN abs(a - b) < 0.02 THEN NULL WHEN (a - b > 0) <> (c > d) THEN 'right' ELSE 'left' END AS near_nose,
  CASE WHEN a - b >= 0.1 THEN 'left' WHEN b - a >= 0.1 THEN 'right' END AS claimed, CASE WHEN b - a >= 0.05 THEN 'left' WHEN a - b >= 0.05 THEN 'right' END AS near_depth,
  round(abs((e - a) * (d - b) - (f - b) * (c - a)) / nullif(sqrt((e - a) ** 2 + (f - b) ** 2), 0) / nullif(sqrt((a - c) ** 2 + (b - d) ** 2) + sqrt((c - e) ** 2 + (d - f) ** 2), 0), 5) AS bend FROM x""")
def geometry_rules(spark, sf_dir):
    """ORI1, ORI11, ORI12, GEO22, AGG31-33, LAB4, LIV12: a vector's elements stand for points."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abcdefgh")))
    c = F.col
    p = [geo.point(c(x), c(y)) for x, y in ("ab", "cd", "ef", "gh")]
    wide, high = F.lit(640.0), F.lit(360.0)
    back = geo.inverse_rotate_point(geo.rotate_point(p[0], 90, wide, high), 90, wide, high)
    pixel = geo.to_pixels(p[0], wide, high)
    return v.select(
        "vec_id", F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 6).alias("back_y"), F.round(pixel["x"], 5).alias("pixel_x"), F.round(pixel["y"], 5).alias("pixel_y"), F.round(geo.percent_to_pixels(p[1], wide, high)["x"], 6).alias("percent_x"),
        geo.is_inverted(c("a"), c("b")).alias("inverted"), F.round(geo.view_width(*p, F.lit(2.0)), 5).alias("width"), geo.near_side_from_nose(c("a"), c("b"), c("c") > c("d"), 0.02).alias("near_nose"),
        geo.claimed_near_side(c("a"), c("b")).alias("claimed"), geo.near_side_from_depth(c("a"), c("b")).alias("near_depth"), F.round(geo.live_banana(*p)["magnitude"], 5).alias("bend"),
    )


# A user stands for a clip, an error for a frame without a person, a purchase for contact.
_SKILL = "CASE user_id % 5 WHEN 0 THEN 'walk' WHEN 1 THEN '' WHEN 2 THEN 'tuck' ELSE 'line' END"


def a_pool(spark, sf_dir):
    s = series(spark, sf_dir)
    frames = s.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame_idx"), (F.col("t") * 1000).cast("long").alias("t_ms"), F.coalesce(F.col("event_type") != "error", F.lit(False)).alias("detected"), F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("trainer_contact"), (F.col("x") > 50).alias("inverted"))
    clip = F.col("clip_id")
    skill = F.when(clip % 5 == 0, "walk").when(clip % 5 == 1, "").when(clip % 5 == 2, "tuck").otherwise("line")
    clips = frames.select("clip_id").distinct().select("clip_id", skill.alias("skill"), (clip % 4).cast("string").alias("session_date"), (clip % 7 != 0).alias("has_video"), (clip % 3 == 0).alias("trainer_present"))
    return sampling.pooled(frames, clips, ["line"])


@query(f"""SELECT coalesce(CASE WHEN s = 'walk' THEN 'walk' WHEN s = '' THEN 'no skill' WHEN s <> 'line' THEN 'other skill' WHEN user_id % 7 = 0 THEN 'no video' WHEN coalesce(event_type = 'error', true) THEN 'no person' END, 'kept') AS excluded_by, count(DISTINCT user_id) AS clips, count(*) AS frames
FROM (SELECT *, {_SKILL} AS s FROM e) GROUP BY 1""")
def frame_pool(spark, sf_dir):
    """SMP1, SMP9."""
    return sampling.ledger(a_pool(spark, sf_dir))


def _sampled(spark, sf_dir):
    pool = settled(a_pool(spark, sf_dir).where("excluded_by is null"))
    n = max(3, pool.count() // 40)
    wanted = dict(zip(sampling.STRATA, sampling.quotas(n), strict=True))
    return pool, sampling.budgeted_picks(pool, wanted, seed=3, spacing=int(DAY * 500))


@query()
def budgeted_sample(spark, sf_dir):
    """SMP4, SMP6: a fortieth of the pool, by quota, budget and spacing."""
    return _sampled(spark, sf_dir)[1].select("clip_id", "frame_idx", "stratum", "nth")


@query()
def held_sample(spark, sf_dir):
    """SMP7, SMP11."""
    pool, picks = _sampled(spark, sf_dir)
    return sampling.swapped_for_holds(picks, pool, spacing=int(DAY * 500)).select("clip_id", "frame_idx", "stratum", "inverted")


@query()
def live_cues(spark, sf_dir):
    """LIV13-15, LIV18, LIV19: a user's events, a day a second, through the chain of detectors."""
    s = series(spark, sf_dir)
    at = F.timestamp_millis((F.col("t") / DAY * 1000).cast("long"))
    x = F.col("x")
    frames = s.select(
        "user_id", "event_id", at.alias("at"), (x > 30).alias("up"), (x > 60).alias("line"), F.when(x.between(40, 55), "bent").alias("fault"), F.when(x < 10, "tooSmall").when(x < 30, "ok").alias("framing"),
        F.array().cast("array<string>").alias("edges"), (x > 30).alias("inverted"), F.lit(False).alias("recording"), (F.col("vis") * 100).alias("inference_ms"),
    )
    return rounded(cues.session_events(frames, "user_id", "at", idle_s=20.0, tie="event_id"), "t", "value", digits=3)


@query("SELECT round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, count(x) AS n FROM e")
def table_quantiles(spark, sf_dir):
    """AGG8, AGG10: quantiles of a whole table."""
    return rounded(reports.quantiles(series(spark, sf_dir), "x"), "p25", "p50", "p75", digits=6)


@query("""SELECT count(*) FILTER (NOT m) AS present, count(*) FILTER (m) AS missing, count(*) FILTER (NOT m AND v) AS variable_rate, count(*) FILTER (NOT m AND p_size % 4 <> 0) AS turned, count(*) FILTER (NOT m AND p_size % 2 = 0) AS dated
FROM (SELECT p_size, p_size % 10 = 0 AS m, coalesce(abs(p_retailprice::DOUBLE - 1000) / 1000 > 0.005, false) AS v FROM part)""")
def catalogue_summary(spark, sf_dir):
    """ING12."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select((size % 10 == 0).alias("missing"), F.col("p_retailprice").cast("double").alias("fps_avg"), F.lit(1000.0).alias("fps_nominal"), (size % 4 * 90).alias("rotation"), F.when(size % 2 == 0, "2026").otherwise("").alias("recorded_at"))
    return ingest.summary(rows)


@checked(
    6,
    """, wd AS (SELECT clip, h::BIGINT AS hold_id FROM sup, range(0, 3) r(h) WHERE clip % 3 < 2 UNION ALL SELECT -1, 0)
SELECT wd.clip AS clip_id, wd.hold_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ft WHERE ft.clip = wd.clip) THEN 'features file missing' WHEN hv.clip IS NULL THEN 'hold id not in features' WHEN valid_frames < 5 THEN 'too few valid frames' END AS note,
  CASE WHEN valid_frames >= 5 THEN round(hip_angle, 3) END AS hip_angle, CASE WHEN valid_frames >= 5 THEN round(com_sway_sd, 4) END AS com_sway_sd FROM wd LEFT JOIN hv ON hv.clip = wd.clip AND hv.hold_id = wd.hold_id""",
)
def reviewed_values(spark, sf_dir):
    """SCO8."""
    clips = pose_queries.seeds(spark, sf_dir).where("clip_id % 3 < 2").select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("hold_id"))
    wanted = clips.unionByName(spark.createDataFrame([(-1, 0)], "clip_id long, hold_id int"))
    out = scoring.reviewed_values(wanted, settled(pose_queries.measured(spark, sf_dir)), pose_queries.RULES)
    return out.select("clip_id", "hold_id", "note", F.round("hip_angle", 3).alias("hip_angle"), F.round("com_sway_sd", 4).alias("com_sway_sd"))


@checked(
    6,
    """, lg AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY clip ORDER BY end_ms - start_ms DESC, hold_id) = 1),
tp AS (SELECT * FROM zz WHERE grp <> '' QUALIFY row_number() OVER (PARTITION BY clip, hold_id ORDER BY w * abs(z) / size DESC, ord) <= 3),
cd AS (SELECT lg.clip, CASE WHEN feature <> 'banana' THEN feature WHEN v > 0 THEN 'banana_pos' WHEN v < 0 THEN 'banana_neg' END AS cue, least(abs(z), 4) / 4 AS severity, row_number() OVER (PARTITION BY lg.clip ORDER BY w * abs(z) / size DESC, ord) AS i FROM lg JOIN tp ON tp.clip = lg.clip AND tp.hold_id = lg.hold_id WHERE abs(z) >= 1.5
  UNION ALL SELECT clip, 'balance_over', 0.4, 10 FROM lg WHERE pct_over > 30 UNION ALL SELECT clip, 'balance_under', 0.4, 11 FROM lg WHERE pct_under > 30),
ok AS (SELECT * FROM cd WHERE cue IS NOT NULL AND cue NOT LIKE 'com%'),
rk AS (SELECT clip, cue, severity, row_number() OVER (PARTITION BY clip ORDER BY severity DESC, i) AS rank FROM ok UNION ALL SELECT clip, 'none', 0, 1 FROM lg WHERE clip NOT IN (SELECT clip FROM ok))
SELECT clip AS clip_id, rank, cue, round(severity, 4) AS severity FROM rk WHERE rank <= 3""",
)
def session_cues(spark, sf_dir):
    """SCO20."""
    frames = settled(pose_queries.measured(spark, sf_dir))
    values = settled(scoring.hold_values(frames.where("hold_id >= 0"), ["clip_id", "hold_id"], "t_ms", pose_queries.RULES))
    scores = scoring.score_holds(values, pose_queries.own_reference(values), pose_queries.RULES)
    out = scoring.session_cues(scores, pose.hold_summary(frames))
    return out.select("clip_id", F.col("rank").cast("long").alias("rank"), "cue", F.round("severity", 4).alias("severity"))
