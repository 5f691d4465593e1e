"""Alignment of a claimed side with a measured side on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def align_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed order totals against the best line of each order: best row, full outer join, status, risk."""
    best = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("b"))
        .select("l_orderkey", F.col("b.l_extendedprice").alias("measured"))
    )
    both = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("claimed")).join(best, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    gap = F.abs(F.col("claimed") - F.col("measured")) / F.greatest(F.abs("claimed"), F.lit(1e-12))
    status = F.when(F.col("o_orderkey").isNull(), "missing_in_paper").when(F.col("l_orderkey").isNull(), "missing_in_code").when(gap <= 0.01, "consistent").otherwise("inconsistent")
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("k"), status.alias("status"))


QUERIES = {"align_orders_lineitem": align_orders_lineitem}

ORACLES = {
    "align_orders_lineitem": """
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) rn FROM lineitem) WHERE rn = 1)
SELECT coalesce(o.o_orderkey, b.l_orderkey) AS k,
       CASE WHEN o.o_orderkey IS NULL THEN 'missing_in_paper' WHEN b.l_orderkey IS NULL THEN 'missing_in_code'
            WHEN abs(o.o_totalprice - b.l_extendedprice) / greatest(abs(o.o_totalprice), 1e-12) <= 0.01 THEN 'consistent'
            ELSE 'inconsistent' END AS status
FROM orders o FULL OUTER JOIN b ON o.o_orderkey = b.l_orderkey
"""
}
