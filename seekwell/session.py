"""Sessions, table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


#: The key of surrogates in local sessions, so results there can be repeated. It is no secret: name another for real data.
LOCAL_KEY = "seekwell"
#: Plans are kept as text for monitoring; of wide expressions that would be many megabytes in the driver.
PLAN_TEXT = "spark.sql.maxPlanStringLength"


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine assumes (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seekwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.seekwell.pii.key", LOCAL_KEY)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under `sf_dir`; Spark reads it, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="seekwell-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    if int(spark.conf.get(PLAN_TEXT, "2147483632")) > 50_000:
        spark.conf.set(PLAN_TEXT, "50000")
    path = new_folder(spark, "seekwell")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
