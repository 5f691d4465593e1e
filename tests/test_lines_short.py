"""Short lists of lines: few jobs for any number of them, the same rows as from the way of long lists, null keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators import lines

from .test_lines import pairs_of_lists, tables

ROW = ["seq", "kind", "a", "b", "line"]


def rows(df, keys=("k",)):
    return sorted(tuple(r) for r in df.select(*keys, *ROW).na.fill("", keys).collect())


def test_same_as_long_lists(spark, monkeypatch):
    for unique in (True, False):
        lists = list(pairs_of_lists(random.Random(5), unique=unique))[-12:]
        old, new = tables(spark, lists, 1), tables(spark, lists, 2)
        short = rows(lines.changes(old, new, ["k"]))
        with monkeypatch.context() as m:
            m.setattr(lines, "SHORT", 40)  # some lists are long, some are not
            some = rows(lines.changes(old, new, ["k"]))
        assert short == some and len({r[0] for r in short}) > 5


def test_few_jobs_and_null_keys(spark):
    tracker = spark.sparkContext.statusTracker()
    old = spark.createDataFrame([(k, i, f"line {i}") for k in ("a", None) for i in range(1, 6)], "k string, line_no int, line string")
    new = old.filter("line_no <> 3")
    spark.sparkContext.setJobGroup("lines", "lines")
    found = lines.changes(old, new, ["k"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("lines")) <= 4
    assert [r for r in rows(found) if r[2] != " "] == [("", 3, "-", 3, None, "line 3"), ("a", 3, "-", 3, None, "line 3")]


def test_sides_that_are_parted_by_the_key(spark):
    number = F.row_number().over(Window.partitionBy("k").orderBy("id"))
    old = spark.range(6000).select((F.col("id") % 300).alias("k"), "id", F.concat(F.lit("line "), "id").alias("line"))
    new = old.filter("id % 11 > 0")
    found = lines.changes(old.withColumn("line_no", number), new.withColumn("line_no", number), ["k"])
    assert {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()} == {"-": 546, " ": 5454}
