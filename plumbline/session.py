"""Sessions for tests, benches and local use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A single-JVM session with the settings the library assumes: UTC and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: a checkpoint in the folder that ``spark.checkpoint.dir`` names, or where none is named (a local session) a cache that is made anew when lost."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    context.setCheckpointDir(folder)
    return df.checkpoint()
