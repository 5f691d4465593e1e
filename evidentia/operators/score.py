"""Readiness: what the findings cost, by category; what was not checked is null, never full marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import PENALTY, lookup

CATEGORIES = ("env", "data", "param", "record", "result")


def readiness(audits: DataFrame, findings: DataFrame, requirements: DataFrame, files: DataFrame, measured: DataFrame) -> DataFrame:
    """One row for each audit and category, and a row "total": the mean of the checked ones, rounded half to even."""
    scored = findings.filter((F.coalesce("paper.channel", F.lit("")) != "vision") & (F.coalesce("code.channel", F.lit("")) != "vision"))
    cost = scored.groupBy("audit_id", "category").agg(F.sum(lookup(F.col("risk"), PENALTY)).alias("cost"))
    grid = audits.select("audit_id", "code_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    code = files.groupBy("code_id").agg(F.lit(True).alias("has_code"))
    needs = requirements.groupBy("code_id").agg(F.lit(True).alias("has_requirements"))
    results = measured.groupBy("audit_id").agg(F.lit(True).alias("has_results"))
    rows = grid.join(cost, ["audit_id", "category"], "left").join(code, "code_id", "left").join(needs, "code_id", "left").join(results, "audit_id", "left").fillna(False, ["has_code", "has_requirements", "has_results"])
    left = F.when(F.col("cost").isNotNull(), F.greatest(F.lit(0), 100 - F.col("cost")))
    score = (
        F.when(F.col("category") == "env", F.when(F.col("has_code"), F.when(F.col("has_requirements"), 100).otherwise(60)))
        .when(F.col("category") == "record", F.when(F.col("has_results"), 100))
        .when(F.col("category") == "result", F.when(F.col("has_results"), left))
        .otherwise(left)
    )
    reason = (
        F.when(score.isNotNull(), "")
        .when(F.col("category") == "env", "未提供代码包，无从核对环境依赖")
        .when(F.col("category").isin("record", "result") & ~F.col("has_results"), "本次未提供实测结果")
        .when(F.col("category") == "result", "已提供实测结果，但论文未声明可对照的指标")
        .otherwise("没有可比对的项")
    )
    out = rows.select("audit_id", "category", score.cast("int").alias("score"), reason.alias("unverified_reason"))
    total = out.groupBy("audit_id").agg(F.bround(F.avg("score")).cast("int").alias("score")).select("audit_id", F.lit("total").alias("category"), "score", F.lit("").alias("unverified_reason"))
    return out.unionByName(total)


def dominant_issues(ordered: DataFrame) -> DataFrame:
    """The first three open findings of high or medium risk; the findings carry their order as seq."""
    open_ = ordered.filter(F.col("risk").isin("high", "medium") & (F.col("status") != "consistent"))
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "display"))), 1, 3), lambda x: x["display"])
    return open_.groupBy("audit_id").agg(names.alias("dominant"))
