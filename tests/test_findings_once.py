"""Findings from one pass over the evidence: both kinds of rows as from their own functions, few scans, ranks without a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import align, inquiry, trace
from evidentia.queries import audits


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, column):
    """How often a plan reads a table, by one of its columns that evidence is made of."""
    return sum("Relation" in line and column in line for line in plan(df).split("\n"))


def test_one_pass(spark):
    claims, code = audits._order_sides(spark, "/root/testdata/sf0.001")
    both = align.compare(claims, code)
    apart = align.align_params(claims, code).unionByName(align.conflicts(claims, code))
    assert scans(both, "l_quantity") == 1 and "Join" not in plan(both)
    assert both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty()
    assert {r[0] for r in both.select("status").distinct().collect()} >= {"inconsistent", "internal_inconsistent", "missing_in_paper"}


def test_conflicts_of_both_sides(spark):
    side = "audit_id string, owner_id string, side string, key string, ordinal bigint, raw_value string, num double, txt string, location string, file string, page int, line int, snippet string, channel string, excluded boolean, form string"
    row = lambda s, o, v, file: ("a", "a", s, "batch_size", o, v, float(v), None, f"{file}:{o}" if file else f"Page {o}", file, 1, o, v, "text", False, "assign")
    paper = spark.createDataFrame([row("paper", 1, "8", None), row("paper", 2, "16", None)], side)
    code = spark.createDataFrame([row("code", 3, "8", "train.py"), row("code", 4, "32", "train.py"), row("code", 5, "64", "tests/a.py")], side)
    found = {r["status"]: r for r in align.compare(paper, code).collect()}
    assert set(found) == {"consistent", "internal_inconsistent"}
    clash = found["internal_inconsistent"]
    assert clash["risk"] == "medium" and clash["paper"]["raw_value"] == "8" and clash["code"]["raw_value"] == "8" and sorted(x["raw_value"] for x in clash["extra"]) == ["16", "32"]
    assert "论文" in clash["note"] and "代码" in clash["note"] and "64" not in clash["note"]


def test_ranks_without_join(spark):
    rows = spark.createDataFrame([("a", f"k{i:02d}", f"d{i:02d}", ["none", "low", "high", None][i % 4]) for i in range(40)], "audit_id string, key string, display string, risk string")
    ranked = inquiry.with_ranks(rows, 15)
    assert "Join" not in plan(ranked) and ranked.count() == 40
    kept = {r["key"]: r["rank"] for r in ranked.filter("rank is not null").collect()}
    assert len(kept) == 15 and kept["k02"] == 1 and kept["k01"] == 11 and all(int(k[1:]) % 4 in (1, 2) for k in kept)
    assert inquiry.repro_risks(rows).count() == 15


def test_traces_read_code_once(spark):
    claims, code = audits._order_sides(spark, "/root/testdata/sf0.001")
    keys = code.select("audit_id", "key").distinct().withColumn("status", F.lit("inconsistent")).withColumn("seq", F.lit(1))
    found = trace.traces(keys.localCheckpoint(), code)
    assert scans(found, "l_quantity") == 1
    ranked = {(r["audit_id"], r["rank"]): (r["file"], r["line"], r["value"]) for r in trace.sites(code).collect()}
    for r in found.limit(200).collect():
        assert [(c["file"], c["line"], c["value"]) for c in r["candidates"]] == [ranked[r["audit_id"], i] for i in range(1, len(r["candidates"]) + 1)]
