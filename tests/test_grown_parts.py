"""Queries over planted parts at size: work over all cores, no side that grows sent whole to every task, and each draft and reading made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import explain, trace
from evidentia.operators.align import stable_readings
from evidentia.operators.budget import fill_within
from evidentia.queries import audits
from evidentia.schemas import READINGS


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_over_all_cores(spark):
    parts = audits._parts(spark, "/root/testdata/sf0.001")
    used = parts.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert parts.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_excerpts_send_nothing_whole(spark):
    pages = spark.createDataFrame([("a", i, "The momentum is what we tune here. Nothing else is said on it.") for i in (1, 2)], "paper_id string, page_no int, text string")
    gaps = spark.createDataFrame([("a", "momentum")], "paper_id string, key string")
    quoted, read = explain.excerpts(pages, gaps), explain.pages_to_read(pages, gaps)
    assert "Broadcast" not in physical(quoted) and "Broadcast" not in physical(read)
    assert quoted.first()["excerpts"].count("momentum") == 2 and [r["page_no"] for r in read.orderBy("page_no").collect()] == [1, 2]


def test_drafts_once(spark):
    paper = "struct<raw_value:string,num:double,txt:string,snippet:string>"
    findings = spark.createDataFrame([("a", "batch_size", 1, "inconsistent", ("32", 32.0, "32", "batch size 32"))], f"audit_id string, key string, seq int, status string, paper {paper}")
    found = spark.createDataFrame([("a", "batch_size", 1, "64", "t.py:5", "t.py", 5, "high")], "audit_id string, key string, seq int, verdict string, verdict_loc string, file string, line int, confidence string")
    lines = spark.createDataFrame([("a", "t.py", i, "batch_size = 64" if i == 5 else f"x{i} = 1") for i in range(1, 8)], "audit_id string, file string, line int, text string")
    claims = spark.createDataFrame([("a", "batch_size", 32.0, "32", False)], "audit_id string, key string, num double, txt string, excluded boolean")
    drafts = trace.patches(findings, found, lines, claims)
    assert physical(drafts).count("ArrowEvalPython") == 1 and "Broadcast" not in physical(drafts)
    (row,) = drafts.collect()
    assert row["after"] == "batch_size = 32" and row["before"] == "batch_size = 64"
    assert row["diff"] == "--- a/t.py\n+++ b/t.py\n@@ -2,6 +2,6 @@\n x2 = 1\n x3 = 1\n x4 = 1\n-batch_size = 64\n+batch_size = 32\n x6 = 1\n x7 = 1"


def test_readings_once(spark):
    rows = [("a", 1, "table", 1, "momentum", "0.9", "seen"), ("a", 1, "table", 2, "momentum", "0.90", "seen"), ("a", 1, "table", 1, "seed", "1", "seen"), ("a", 1, "table", 2, "seed", "2", "seen"), ("a", None, "table", 1, "epochs", "3", "seen"), ("a", None, "table", 2, "epochs", "3", "seen")]
    both = stable_readings(spark.createDataFrame(rows, READINGS))
    assert [(r["key"], r["value"], r["run"]) for r in both.collect()] == [("momentum", "0.9", 1)] and "Join" not in physical(both)


def test_ports_answer_once(spark):
    made = spark.sparkContext.accumulator(0)

    def reading(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    def read(requests):
        runs = requests.select("paper_id", F.lit(1).alias("page_no"), F.lit("table").alias("region_kind"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), F.col("key").alias("name"), F.lit("0.5").alias("value"), F.lit("seen").alias("evidence_text"))
        return runs.mapInPandas(reading, runs.schema)

    pages = spark.createDataFrame([("a", 1, "seed and momentum", 0)], "paper_id string, page_no int, text string, n_images int")
    mentioned = spark.createDataFrame([("a", "momentum")], "paper_id string, key string")
    out = fill_within(pages, mentioned, spark.createDataFrame([], "owner_id string, key string"), None, read)
    assert [(r["key"], r["tool"], r["value"]) for r in out["fills"].collect()] == [("momentum", "images", "0.5")]
    assert made.value == 2 and out["trace"].filter("tool = 'images' and status = 'accepted'").count() == 1
