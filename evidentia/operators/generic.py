"""Relational kernels of an audit on any table: best row, alignment, tolerance, conflicts, carry-forward, top-k, folding.

Every "best" or "first" takes a total order: the caller names the columns, and the row itself breaks ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.folders import at_rest, scratch


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row of each key that is least by ``order``, then by the kept columns. A minimum of structs combines
    map-side, so a hot key costs one row a task; no sort is needed."""
    ranked = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*ranked, *keep)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep])


def relative_gap(claimed: Column, measured: Column) -> Column:
    return F.abs(claimed - measured) / F.greatest(F.abs(claimed), F.lit(1e-12))


def align_status(claimed: Column, measured: Column, tolerance: float) -> Column:
    return (
        F.when(claimed.isNull() & measured.isNull(), F.lit(None).cast("string"))
        .when(claimed.isNull(), "missing_in_paper")
        .when(measured.isNull(), "missing_in_code")
        .when(relative_gap(claimed, measured) <= tolerance, "consistent")
        .otherwise("inconsistent")
    )


def tolerance_band(claimed: Column, measured: Column) -> Column:
    """none within 1 %; high from a difference of 2 or from 5 %; else medium."""
    gap = relative_gap(claimed, measured)
    return F.when(gap <= 0.01, "none").when((F.abs(claimed - measured) >= 2.0) | (gap >= 0.05), "high").otherwise("medium")


def distinct_first(df: DataFrame, keys: Sequence[str], value: str, ordinal: Sequence[str]) -> DataFrame:
    """Distinct values of a key with the place where each is first seen."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*ordinal)).alias("_f"), F.count("*").alias("n")).select(*keys, value, *[F.col(f"_f.{c}").alias(c) for c in ordinal], "n")


def internal_conflict(df: DataFrame, key: str, value: str, carrier: str) -> DataFrame:
    """Keys with several values; medium risk if one carrier holds them all, else low."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.countDistinct(carrier).alias("n_carriers"))
    return counted.filter("n_values > 1").withColumn("risk", F.when(F.col("n_carriers") > 1, "low").otherwise("medium"))


def rank_gap(df: DataFrame, key: str, score: Column, ties: Sequence[str]) -> DataFrame:
    """Top score of a key, its lead over the second, the number of candidates, and how sure the top one is.
    The two best come from a bounded window group, whatever the size of the key."""
    scored = df.withColumn("_s", score)
    order = Window.partitionBy(key).orderBy(F.desc("_s"), *ties)
    two = scored.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    tops = two.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("_s"))).alias("top"), F.max(F.when(F.col("_r") == 2, F.col("_s"))).alias("second"))
    counts = df.groupBy(key).agg(F.count("*").alias("n_sites"))
    verdict = F.when(F.col("second").isNull(), "high").when(F.col("top") - F.col("second") >= 3, "medium").otherwise("none")
    return tops.join(counts, key).select(key, "top", "second", "n_sites", verdict.alias("verdict"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row: an as-of join of a table with itself."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def line_table(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row a line, numbered from 1."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def line_context(lines: DataFrame, keys: Sequence[str], before: int = 1, after: int = 2) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.concat_ws("\n", F.collect_list("line").over(w)))


def fold_oldest(df: DataFrame, key: str, order: Sequence[Column], keep: int) -> DataFrame:
    """Rank a key's rows newest first; those beyond ``keep`` are marked to be folded into a digest."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.withColumn("folded", F.col("rank") > keep)


def both_ways(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that disappeared and rows that are new, as multisets."""
    gone = old.exceptAll(new).withColumn("change", F.lit("gone"))
    return gone.unionByName(new.exceptAll(old).withColumn("change", F.lit("new")))


def prefix_sums(df: DataFrame, order: Sequence[Column], value: Column, parts: int = 200) -> DataFrame:
    """Add ``_n`` and ``_sum``: the number of rows and the sum of ``value`` up to each row of a table in one total order.

    Ranges of the order are dealt to ``parts`` tasks and written once, as a second sampling may cut them elsewhere; sums of ranges, one row each,
    give what lies before a range, and each range is scanned by itself. No task sees more than its range. Rows that are equal in
    ``order`` are in one range and in no certain order."""
    dealt = df.withColumn("_value", value.cast("bigint")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt = at_rest(dealt, scratch(df.sparkSession, "ranges"))
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows at most
    sums = sums.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_total"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = dealt.join(F.broadcast(sums), "_range").withColumn("_n", F.col("_rows") + F.count("*").over(within)).withColumn("_sum", F.col("_total") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return scanned.drop("_range", "_rows", "_total", "_value")
