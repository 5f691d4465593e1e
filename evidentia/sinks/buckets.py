"""Keyed tables in hash buckets of Parquet files.

A write makes a new generation, a folder that holds the buckets it touches and no others; Spark's job commit, which leaves the
file ``_SUCCESS``, makes it valid at once. Of each bucket a reader takes the newest valid generation, so that it sees a write
whole or not at all, and a write that failed is never seen. A bucket that a write leaves empty holds one row that says so.
There is one writer at a time; generations that none of the last ``KEPT`` needs are removed by the next write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KEPT = 64, 2


@dataclass(frozen=True)
class BucketStore:
    """A table below ``path``; ``keys`` name the columns of ``schema`` that tell what a write replaces. The number of buckets stays as it is
    once a store is begun; it bounds how many paths a reader opens."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _fs(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/of={self.buckets}")
        return root, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, fs, path) -> list[str]:
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def generations(self, spark: SparkSession) -> dict[int, list[int]]:
        """The buckets of each valid generation."""
        root, fs = self._fs(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path
        others = [n for n in self._children(fs, root.getParent()) if n.startswith("of=") and n != root.getName()]
        if others:
            raise ValueError(f"{self.path} was begun with {others[0]} buckets")
        valid = [n for n in self._children(fs, root) if fs.exists(path(f"{root}/{n}/_SUCCESS"))]
        return {int(n[4:]): [int(b[7:]) for b in self._children(fs, path(f"{root}/{n}")) if b.startswith("bucket=")] for n in valid}

    def newest(self, spark: SparkSession) -> dict[int, int]:
        """The generation that holds each bucket now."""
        return {b: g for g, buckets in sorted(self.generations(spark).items()) for b in buckets}

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        now = self.newest(spark)
        paths = [f"{self.path}/of={self.buckets}/gen={g:012d}/bucket={b}" for b, g in sorted(now.items()) if buckets is None or b in buckets]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(f"{self.schema}, _live boolean").parquet(*paths).filter("_live").drop("_live")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the keys of these rows."""
        return self._buckets(rows)

    def rewrite(self, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows`` in the place of all that these buckets hold."""
        self._write(rows, buckets)

    def _buckets(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most as many as there are buckets

    def replace(self, fresh: DataFrame, touched: DataFrame) -> list[int]:
        """Put the rows ``fresh`` in the place of all rows with the keys ``touched``, which hold those of ``fresh``. Gives the buckets that were
        written: those where the rows of a key change. A repeated write changes nothing and writes nothing."""
        spark = fresh.sparkSession
        columns = spark.createDataFrame([], self.schema).columns
        keys, fresh = touched.select(*self.keys).distinct(), fresh.select(columns)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        ours = lambda df, how: df.alias("a").join(keys.alias("b"), same, how)
        now = self.read(spark, self._buckets(keys))
        row = F.xxhash64(F.to_json(F.struct(*columns)))
        mark = lambda df, name: df.groupBy(*self.keys).agg(F.struct(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).alias(name))
        before, after = mark(ours(now, "left_semi"), "was"), mark(fresh, "is")
        other = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        changed = before.alias("a").join(after.alias("b"), other, "full_outer").filter(~F.col("was").eqNullSafe(F.col("is")))
        written = self._buckets(changed.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self.keys]))
        if written:
            kept = ours(self.read(spark, written), "left_anti").select(columns)
            self._write(kept.unionByName(fresh.filter(self.bucket().isin(written))), written)
        return written

    def upsert(self, fresh: DataFrame, newest: Column, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """One row a key: that with the greatest ``newest``, of the table's and the fresh ones; a row that is not newer than the table's changes
        nothing. ``combine`` takes (rows of the table, newer fresh rows), both of the touched keys, and gives what is to be there."""
        spark = fresh.sparkSession
        columns = spark.createDataFrame([], self.schema).columns
        best = fresh.select(*columns, newest.alias("_new")).groupBy(*self.keys).agg(F.max(F.col("_new")).alias("_new"))
        every = fresh.select(*columns, newest.alias("_new"))
        now = self.read(spark, self._buckets(best)).select(*columns, newest.alias("_was"))
        same = lambda: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        newer = every.alias("a").join(now.select(*self.keys, "_was").alias("b"), same(), "left").filter("_was is null or _new > _was").select(*[f"a.{c}" for c in columns], "_new")
        touched = newer.select(*self.keys).distinct()
        if combine is None:
            rest = [c for c in columns if c not in self.keys]
            final = newer.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct("_new", F.to_json(F.struct(*rest)))).alias("m")).select(*self.keys, "m.*")
        else:
            final = combine(now.alias("a").join(touched.alias("b"), same(), "left_semi").select(columns), newer.select(columns))
        return self.replace(final, touched)

    def _write(self, rows: DataFrame, written: list[int]) -> None:
        spark = rows.sparkSession
        root, fs = self._fs(spark)
        here = self._children(fs, root)
        at = f"{root}/gen={max((int(n[4:]) for n in here), default=0) + 1:012d}"
        marks = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(b).cast("int") for b in written])).alias("bucket"), F.lit(False).alias("_live"))
        live = rows.withColumn("bucket", self.bucket()).withColumn("_live", F.lit(True))
        every = live.unionByName(marks, allowMissingColumns=True)
        # without adaptive execution, as in streams with state, Spark ignores the hint, and every task would write a file of every bucket
        adaptive = str(spark.conf.get("spark.sql.adaptive.enabled")).lower() == "true"
        every = every.hint("rebalance", "bucket") if adaptive else every.repartition(len(written), "bucket")
        every.write.mode("overwrite").partitionBy("bucket").parquet(at)
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        """Remove buckets that a later generation has, but for what the last ``KEPT`` generations left valid."""
        root, fs = self._fs(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path
        every = self.generations(spark)
        for g in sorted(every)[:-KEPT]:
            left = [b for b in every[g] if not any(b in every[h] for h in every if g < h <= sorted(every)[-KEPT])]
            for b in set(every[g]) - set(left):
                fs.delete(path(f"{root}/gen={g:012d}/bucket={b}"), True)
            if not left:
                fs.delete(path(f"{root}/gen={g:012d}"), True)
