"""Session helpers: where to put checkpoints, and how to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinspark")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where the setting is absent and the master is local."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kinspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost
    executor loses nothing and the plan starts anew from files."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return _sized(df.checkpoint(eager=True))


def _sized(kept: DataFrame) -> DataFrame:
    """A checkpoint keeps the estimate of its plan's size, for joins the product of their
    sides: over many steps a number of millions of digits. Beyond what a long holds the
    rows go on without one, which is as good."""
    plan = kept._jdf.queryExecution().logical()
    if "E+" not in plan.stats().simpleString():  # so written from 2^71 bytes on
        return kept
    spark, jvm = kept.sparkSession, kept.sparkSession._jvm
    none = jvm.scala.Option.empty()
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: like cut(), for rows
    that are read by column or more than once; smaller than a checkpoint's files."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
