"""Reading and writing the engine's tables: schemas that are checked, unknown values as nulls."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.geometry import finite
from plumbline.functions.text import display_size, parse_frame_rate, recorded_at, strict_bool, variable_frame_rate

# The body's joints in order.
JOINTS = (
    "nose left_eye_inner left_eye left_eye_outer right_eye_inner right_eye right_eye_outer left_ear right_ear mouth_left mouth_right "
    "left_shoulder right_shoulder left_elbow right_elbow left_wrist right_wrist left_pinky right_pinky left_index right_index left_thumb right_thumb "
    "left_hip right_hip left_knee right_knee left_ankle right_ankle left_heel right_heel left_foot_index right_foot_index"
).split()

KEYPOINTS = T.StructType(
    [
        T.StructField("clip_id", T.StringType()), T.StructField("frame_idx", T.LongType()), T.StructField("t_ms", T.LongType()), T.StructField("person_idx", T.LongType()),
        T.StructField("joint", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
        T.StructField("visibility", T.DoubleType()), T.StructField("presence", T.DoubleType()), T.StructField("detected", T.BooleanType()), T.StructField("rotated", T.BooleanType()),
    ]
)


def require(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """SRC9-14: ``df`` if it has the columns; else an error that names what is missing and who writes it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks {', '.join(missing)}; has {', '.join(df.columns)}")
    return df


def known(df: DataFrame) -> DataFrame:
    """NaN and infinities in every double column as nulls."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_keypoints(spark: SparkSession, path: str, source: str = "the keypoint table") -> DataFrame:
    """SRC2, SRC10: a long keypoint table; the clip is the file's name where there is no clip column."""
    df = spark.read.parquet(path)
    if "clip_id" not in df.columns:
        df = df.withColumn("clip_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))
    return known(require(df, ["clip_id", "frame_idx", "t_ms", "joint", "x", "y", "visibility"], source))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """SRC5, SRC6: a CSV of detections in the shared schema; text that is neither true nor false ends the query."""
    schema = "frame_idx bigint, t_ms bigint, person_idx bigint, joint string, x double, y double, confidence double, detected string, rotated string"
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(
        "frame_idx", "t_ms", "person_idx", "joint", "x", "y", F.lit(None).cast("double").alias("z"), F.col("confidence").alias("visibility"), F.lit(None).cast("double").alias("presence"),
        strict_bool(F.col("detected"), "detected").alias("detected"), strict_bool(F.col("rotated"), "rotated").alias("rotated"),
    )


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC17, SRC22: a table, or an empty one of its schema where nothing is at the path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def whole_frames(keypoints: DataFrame, keys: list[str]) -> DataFrame:
    """SRC9: a row a frame with a point for every joint; a frame with a joint twice or two times ends the query."""
    point = lambda j: F.max(F.when(F.col("joint") == j, F.struct("x", "y", "visibility"))).alias(j)
    frames = keypoints.groupBy(*keys, "frame_idx").agg(
        F.min("t_ms").alias("t_ms"), F.count(F.lit(1)).alias("_n"), F.countDistinct("joint").alias("_j"), F.countDistinct("t_ms").alias("_t"), *map(point, JOINTS)
    )
    told = F.concat(F.lit("frame "), F.col("frame_idx").cast("string"), F.lit(" holds a joint twice or two times"))
    checked = frames.withColumn("t_ms", F.when((F.col("_n") == F.col("_j")) & (F.col("_t") == 1), F.col("t_ms")).otherwise(F.raise_error(told).cast("bigint")))
    return checked.drop("_n", "_j", "_t")


def joint_rows(frames: DataFrame, keys: list[str], people: str | None = None) -> DataFrame:
    """SRC3, SRC4, ATH28: long rows, one a joint; frames without anybody give a block of nulls."""
    names = F.array(*map(F.lit, JOINTS))
    if people:
        frames = frames.select(*keys, F.posexplode_outer(people).alias("person_idx", "_p")).withColumn("person_idx", F.coalesce("person_idx", F.lit(-1)))
        point: Column = F.element_at(F.col("_p"), F.col("joint"))
        keys = [*keys, "person_idx"]
    else:
        point = F.element_at(F.map_from_arrays(names, F.array(*(F.col(j) for j in JOINTS))), F.col("joint"))
    return frames.withColumn("joint", F.explode(names)).select(*keys, "joint", point.alias("_q")).select(*keys, "joint", "_q.*")


def replace_table(df: DataFrame, path: str) -> None:
    """SRC18: the table at the path after the next write, never while it is read: written beside it, then moved there."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    jvm = spark.sparkContext._jvm
    here, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the old one stands aside until the new one is there, so a crash leaves one of them whole
    aside = jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    there = fs.exists(here)
    if there and not fs.rename(here, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, here):
        if there:
            fs.rename(aside, here)
        raise OSError(f"{beside} could not become {path}")
    if there:
        fs.delete(aside, True)


def list_clips(spark: SparkSession, folder: str, suffix: str = "parquet", wanted: DataFrame | None = None) -> DataFrame:
    """SRC8, SRC15: clip_id and path of the files of a folder with a suffix, all or those of ``wanted`` (clip_id)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path")
    clips = files.select(F.regexp_extract("path", rf"([^/]*)\.{suffix}$", 1).alias("clip_id"), "path")
    return clips if wanted is None else clips.join(wanted.select("clip_id"), "clip_id", "left_semi")


def append_rows(df: DataFrame, path: str) -> None:
    """SRC19: rows added to a table; what is there stays as it is."""
    df.write.mode("append").parquet(path)


# Keys and words of the labelling tool's export.
LABEL_KEYS, POINT_TYPES, UNCLEAR = ("label", "labels", "keypointlabels"), ("keypointlabels", "keypoints", "keypoint"), ("occluded", "unsure")
IMAGE_KEYS, AUTHOR_KEYS, NAME_KEYS, TIME_KEYS = ("image", "image_path", "path"), ("completed_by", "created_by", "annotator"), ("email", "username", "first_name"), ("updated_at", "created_at", "completed_at")


def _at(v: Column, path: str, kind: str) -> Column:
    """What a VARIANT holds at a path; null where it is absent or of another kind."""
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds text that is not empty."""
    words = lambda p: F.when(_kind(_at(v, p, "variant")) == "STRING", F.nullif(_at(v, p, "string"), F.lit("")))
    return F.coalesce(*map(words, paths))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _truth(v: Column, path: str) -> Column:
    """A flag as it was meant: true, a number that is not 0, text that is not empty; null where there is none."""
    return F.coalesce(_at(v, path, "boolean"), _at(v, path, "double") != 0, F.when(_kind(_at(v, path, "variant")) == "STRING", _at(v, path, "string") != ""))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC20, LAB5: a row for each joint label of the tool's JSON export, nested as it writes it: tasks, their annotations, their results.

    A file holds a list of tasks or an object with such a list under ``tasks``; anything else ends the query. Rows have task, image, annotation
    (its place in the task), joint (the label as written), x and y in percent, visible, labeler and labeled_at. A result counts
    as a point by its type, or without a type by having coordinates and a label; a point whose coordinates are no numbers
    is left out. A point is visible by its own flags, else unless the annotation says occluded or unsure anywhere.
    """
    text = spark.read.option("wholetext", True).text(path)
    whole = text.select(F.try_parse_json("value").alias("v"))
    kind = F.coalesce(_kind(F.col("v")), F.lit("no JSON"))
    found = F.when(kind.startswith("ARRAY"), _at(F.col("v"), "$", "array<variant>")).when(_kind(_at(F.col("v"), "$.tasks", "variant")).startswith("ARRAY"), _at(F.col("v"), "$.tasks", "array<variant>"))
    tasks = whole.select(F.posexplode(F.coalesce(found, F.raise_error(F.concat(F.lit("expected a list of tasks or an object with a list of tasks, got "), kind)).cast("array<variant>"))).alias("task", "t"))
    tasks = tasks.where(_kind(F.col("t")).startswith("OBJECT"))
    notes = tasks.select("task", _text(F.col("t"), *(f"$.data.{k}" for k in IMAGE_KEYS)).alias("image"), F.posexplode(_list(F.col("t"), "$.annotations")).alias("annotation", "a"))
    author = F.coalesce(*(c for k in AUTHOR_KEYS for c in (_text(F.col("a"), f"$.{k}"), _text(F.col("a"), *(f"$.{k}.{n}" for n in NAME_KEYS)))), F.lit(""))
    results = _list(F.col("a"), "$.result")
    choices = F.flatten(F.transform(results, lambda r: F.concat(_list(r, "$.value.choices"), F.array(_at(r, "$.value.choices", "variant")), _list(r, "$.value"))))
    unclear = F.exists(choices, lambda c: F.coalesce(F.lower(F.trim(F.try_variant_get(c, "$", "string"))).isin(*UNCLEAR), F.lit(False)))
    points = notes.select("task", "image", "annotation", author.alias("labeler"), F.coalesce(_text(F.col("a"), *(f"$.{k}" for k in TIME_KEYS)), F.lit("")).alias("labeled_at"), unclear.alias("_unclear"), F.explode(results).alias("r"))
    one = lambda k: F.when(_kind(_at(F.col("r"), f"$.value.{k}", "variant")) == "STRING", F.array(_at(F.col("r"), f"$.value.{k}", "string")))
    many = lambda k: F.transform(_list(F.col("r"), f"$.value.{k}"), lambda v: F.try_variant_get(v, "$", "string"))
    labels = F.concat(*(F.coalesce(one(k), many(k)) for k in LABEL_KEYS))
    sort = F.lower(F.coalesce(_text(F.col("r"), "$.type"), F.lit("")))
    is_point = sort.isin(*POINT_TYPES) | ((sort == "") & _at(F.col("r"), "$.value.x", "variant").isNotNull())
    number = lambda k: finite(F.coalesce(_at(F.col("r"), f"$.value.{k}", "double"), _at(F.col("r"), f"$.value.{k}", "string").try_cast("double")))
    flag = lambda k: _truth(F.col("r"), f"$.value.{k}")
    visible = F.coalesce(flag("visible"), flag("visibility"), ~flag("occluded"), ~F.col("_unclear"))
    rows = points.where(is_point).select("task", "image", "annotation", F.explode(labels).alias("joint"), number("x").alias("x"), number("y").alias("y"), visible.alias("visible"), "labeler", "labeled_at")
    return rows.where("x is not null and y is not null")


def probe_rows(probes: DataFrame, name: str = "filename", document: str = "probe") -> DataFrame:
    """ING6: ``probes`` with the facts of a media probe's JSON: duration_s, fps_avg, fps_nominal, is_vfr, width, height, rotation, display_width, display_height, bitrate_kbps, codec and recorded_at.

    The first video stream counts; a clip that could not be probed keeps its row, with nulls.
    """
    v = probes.withColumn("_v", F.try_parse_json(document))
    video = F.get(F.filter(_list(F.col("_v"), "$.streams"), lambda s: F.coalesce(F.try_variant_get(s, "$.codec_type", "string") == "video", F.lit(False))), F.lit(0))
    v = v.withColumn("_s", video)
    whole = lambda p: F.coalesce(_at(F.col("_s"), p, "string").try_cast("double").cast("int"), F.when(F.col("_s").isNotNull(), 0))
    turn = F.get(F.filter(F.transform(_list(F.col("_s"), "$.side_data_list"), lambda d: F.try_variant_get(d, "$.rotation", "string").try_cast("double").cast("int")), lambda r: r.isNotNull()), F.lit(0))
    v = v.withColumns({"width": whole("$.width"), "height": whole("$.height"), "rotation": F.coalesce(turn, F.when(F.col("_s").isNotNull(), 0))})
    rate = lambda k: parse_frame_rate(_at(F.col("_s"), f"$.{k}", "string"))
    size = display_size(F.col("width"), F.col("height"), F.col("rotation"))
    number = lambda k: finite(_at(F.col("_v"), f"$.format.{k}", "string").try_cast("double"))
    v = v.withColumns({"fps_avg": rate("avg_frame_rate"), "fps_nominal": rate("r_frame_rate"), "display_width": size["width"], "display_height": size["height"], "duration_s": number("duration")})
    v = v.withColumns({"is_vfr": F.when(F.col("_s").isNotNull(), variable_frame_rate(F.col("fps_avg"), F.col("fps_nominal"))), "bitrate_kbps": F.bround(number("bit_rate") / 1000).cast("long"), "codec": _at(F.col("_s"), "$.codec_name", "string"), "recorded_at": recorded_at(F.col(name))})
    return v.drop("_v", "_s")


def read_hold_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """SRC21, SRC23: a CSV of holds; cells of ``numbers`` that are no numbers are null, and rows without clip or hold are left out."""
    raw = spark.read.option("header", True).csv(path)
    typed = require(raw, ["clip_id", "hold_id", *numbers], path).withColumns({"hold_id": F.col("hold_id").try_cast("bigint"), **{c: F.col(c).try_cast("double") for c in numbers}})
    return typed.where(F.col("clip_id").isNotNull() & F.col("hold_id").isNotNull())


# What a reference says of itself, as patterns.
REFERENCE_MARKS = {"schema": ".*-reference", "version": "1", "signs": "athlete"}


def read_reference(spark: SparkSession, path: str, features: list[str], marks: dict[str, str] | None = None) -> DataFrame:
    """SRC24: feature, mean, sd and n of the features that a reference's JSON carries, which may be some of ``features`` only.

    Another schema, version or sign rule (``marks``), a feature by another name, a mean or sd that is not a finite number, a negative sd
    or a count that is no whole number of 0 or more ends the query and says which.
    """
    text = spark.read.option("wholetext", True).text(path)
    whole = text.select(F.try_parse_json("value").alias("v"))
    refuse = lambda *told: F.raise_error(F.concat(*(t if isinstance(t, Column) else F.lit(t) for t in told)))
    wrong = F.when(~F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False)), F.lit("a reference is a JSON object"))
    for key, value in (REFERENCE_MARKS if marks is None else marks).items():
        said = F.coalesce(_at(F.col("v"), f"$.{key}", "string"), F.lit("nothing"))
        wrong = wrong.when(~said.rlike(f"^{value}$"), F.concat(F.lit(f"{key} is "), said, F.lit(f", not {value}")))
    entries = _at(F.col("v"), "$.features", "map<string,variant>")
    wrong = wrong.when(entries.isNull(), F.lit("features is no object"))
    rows = whole.select(F.explode(F.when(wrong.isNotNull(), refuse(wrong).cast("map<string,variant>")).otherwise(entries)).alias("feature", "s"))
    number = lambda k: F.when(~_kind(_at(F.col("s"), f"$.{k}", "variant")).isin("STRING", "BOOLEAN"), finite(_at(F.col("s"), f"$.{k}", "double")))
    count = F.when(_kind(_at(F.col("s"), "$.n", "variant")) == "BIGINT", _at(F.col("s"), "$.n", "bigint"))
    rows = rows.select("feature", number("mean").alias("mean"), number("sd").alias("sd"), count.alias("n"))
    bad = F.when(~F.col("feature").isin(*features), " is not a scored feature").when(F.col("mean").isNull(), " has no mean").when(F.col("sd").isNull(), " has no sd").when(F.col("sd") < 0, " has an sd below 0").when(F.col("n").isNull() | (F.col("n") < 0), " has no count")
    return rows.withColumn("mean", F.when(bad.isNotNull(), refuse(F.col("feature"), bad).cast("double")).otherwise(F.col("mean")))


def fixture_json(*columns: str) -> Column:
    """STR12: the columns as one JSON object, in the order given; what is not finite is null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
