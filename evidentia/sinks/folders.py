"""Tables that several jobs read, written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset, one of our own in local mode, whose workers share this
    machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            base = given.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def at_rest(df: DataFrame, path: str) -> DataFrame:
    """Write a table over what is at ``path`` and read it back: it is computed once, and lost executors lose nothing of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
