"""Session helpers of this subpackage: reading tables, bounded Arrow batches, reliable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of two numbers that are sent to every executor (some 50 MB there); more are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Bytes of one Arrow batch sent to a Python worker; bounds a worker's memory when texts are long.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` besides Spark's bound in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder that the cluster names. Where none is named, one of our own in local mode,
    whose workers share this machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """The rows of ``docs`` whose keys (columns of ``gone`` by expressions over ``docs``) are not in ``gone``; nulls are equal.

    ``gone`` is written and counted: up to ``SENT_ROWS`` rows go to every executor and no text moves; more are joined by
    a shuffle, with the same rows as result."""
    gone = cut(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct(), name)
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    same = [expression.eqNullSafe(F.col(f"_gone_{k}")) for k, expression in keys.items()]
    return docs.join(gone, same, "left_anti")


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a few rows through Arrow, which needs no Python worker on the executors."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(names, columns, strict=True)}))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: its lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
