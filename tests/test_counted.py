"""Counts in passing equal the groups of what was written, and every table is written by one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.plans.counted import BY, OTHER, reasons, write_audit, write_counted


def test_counts_equal_groups(spark, tmp_path):
    labels = reasons()
    assert len(labels) == len(set(labels)) > 10
    rejected = spark.range(300).select(F.when(F.col("id") % 7 == 0, "unheard of").otherwise(F.element_at(F.array(*map(F.lit, labels[:5])), (F.col("id") % 5 + 1).cast("int"))).alias("reason"))
    tables = {"rejected": rejected, "findings": spark.range(40).select(F.when(F.col("id") < 9, "high").otherwise("none").alias("risk")), "failed_files": spark.range(3).toDF("n"), "paper_evidence": spark.range(0).select(F.lit("text").alias("channel"))}
    got = {(r["table"], r["value"]): r["n"] for r in write_audit(tables, f"file://{tmp_path}").collect()}
    for name in tables:
        back = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert got[name, None] == back.count()
        if BY[name]:
            groups = {r[0] if r[0] in labels or name != "rejected" else OTHER: r[1] for r in back.groupBy(BY[name]).count().collect()}
            assert {v: n for (t, v), n in got.items() if t == name and v is not None} == groups


def test_one_pass(spark, tmp_path):
    """Each row is made once, though it is written and counted."""
    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    found = write_counted(spark.range(1000, numPartitions=4).mapInArrow(once, "id long").withColumn("v", (F.col("id") % 3).cast("string")), f"file://{tmp_path}/t", "v", ["0", "1"])
    assert found == {None: 1000, "0": 334, "1": 333, OTHER: 333} and made.value == 1000
