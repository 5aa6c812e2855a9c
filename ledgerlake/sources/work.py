"""The folder that all executors share, for files that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder. A local one is made only where the session runs on this machine alone."""
    where = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set(CHECKPOINT_CONF, where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the checkpoint folder and read back: what it costs is paid once, however often it is read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
