"""Shared scratch space: written tables that survive lost executors and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none and runs on this machine alone (tests), a local one is made and set."""
    where = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set(CHECKPOINT_CONF, where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: one run, short lineage."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch between executors and their Python workers, unless the session sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20))}


def lean_batches(spark: SparkSession) -> None:
    """Batches of whole texts stay small, in the JVM and in the workers alike; one long text makes a larger one."""
    own = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for k, (usual, ours) in BATCH.items():
        if k not in own and (usual is None or spark.conf.get(k) == usual):
            spark.conf.set(k, ours)


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
