"""Reports as text: Markdown of an audit and of its repeat pack, JSON of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.lines import changes

STATUS = {"consistent": "一致", "inconsistent": "不一致", "missing_in_code": "代码缺失", "missing_in_paper": "论文未声明", "not_fixed": "未固定", "unverifiable": "无法验证", "internal_inconsistent": "内部不一致"}
SECTIONS = ("readiness", "coverage", "overview", "findings", "manual", "questions", "rejected", "selfcheck", "traces", "patches")


def _label(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, v) for k, v in STATUS.items()], status)


def _side(name: str, side: str) -> Column:
    s = F.col(side)
    return F.when(s.isNotNull(), F.concat(F.lit(f"- {name}: `"), F.coalesce(s["raw_value"], F.lit("")), F.lit("` @ "), F.coalesce(s["location"], F.lit("")), F.lit("\n  > "), F.coalesce(s["snippet"], F.lit(""))))


def finding_block() -> Column:
    title = F.concat(F.lit("### "), "display", F.lit(" — "), _label(F.col("status")), F.lit(" ("), "risk", F.lit(")"))
    reason = F.when(F.col("risk_reason") != "", F.concat(F.lit("- "), "risk_reason"))
    return F.concat_ws("\n", title, _side("论文", "paper"), _side("代码", "code"), reason, F.when(F.col("note") != "", F.concat(F.lit("- "), "note")))


def _lines(df: DataFrame, section: str, order: list[str], text: Column) -> DataFrame:
    return df.select("audit_id", F.lit(SECTIONS.index(section)).alias("s"), F.to_json(F.struct(*[F.format_string("%012d", F.col(c)).alias(c) if t in ("int", "bigint") else F.col(c).cast("string").alias(c) for c in order for t in [dict(df.dtypes)[c]]])).alias("o"), text.alias("t"))


def markdown(tables: dict[str, DataFrame]) -> DataFrame:
    """(audit_id, report) of all audits. Sections without rows are left out; the text does not depend on partitions."""
    f = tables["findings"]
    parts = [
        _lines(tables["readiness"], "readiness", ["category"], F.concat(F.lit("- "), "category", F.lit(": "), F.coalesce(F.col("score").cast("string"), F.concat(F.lit("— "), "unverified_reason")))),
        _lines(tables["coverage"], "coverage", ["audit_id"], F.concat(F.lit("- 审计可信度 "), "confidence_score", F.lit("（"), "level", F.lit("）; 页 "), "pages_covered", F.lit("/"), "pages_total", F.lit("; 代码文件 "), "code_ok", F.lit("/"), "code_files")),
        _lines(f, "overview", ["seq"], F.concat(F.lit("| "), "display", F.lit(" | "), _label(F.col("status")), F.lit(" | "), "risk", F.lit(" |"))),
        _lines(f, "findings", ["seq"], finding_block()),
        _lines(tables["rejected"], "rejected", ["key", "location", "value"], F.concat(F.lit("- "), "key", F.lit(" = `"), "value", F.lit("` @ "), "location", F.lit(": "), "reason")),
        _lines(f.filter("not verified"), "selfcheck", ["seq"], F.concat(F.lit("- "), "display", F.lit(": "), "verify_note")),
    ]
    for name, text in (("manual", F.concat(F.lit("- "), "what")), ("questions", F.concat(F.lit("- "), "question")), ("traces", F.concat(F.lit("- "), "key", F.lit(": "), F.coalesce("verdict_loc", F.lit("—")), F.lit(" "), "reason")), ("patches", F.concat(F.lit("- "), "key", F.lit(": "), "status", F.lit(" "), "refuse_kind"))):
        if name in tables:
            order = {"manual": ["level", "kind", "what"], "questions": ["priority", "qid"], "traces": ["key"], "patches": ["key"]}[name]
            parts.append(_lines(tables[name], name, order, text))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    heads = F.array(*[F.lit(s) for s in SECTIONS])
    section = every.groupBy("audit_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("body"))
    section = section.withColumn("body", F.concat(F.lit("## "), F.get(heads, F.col("s")), F.lit("\n\n"), "body"))
    return section.groupBy("audit_id").agg(F.concat(F.lit("# Audit\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "body"))), lambda x: x["body"]), "\n\n")).alias("report"))


def repro_markdown(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), "display", F.lit(" | "), F.coalesce("paper_value", F.lit("-")), F.lit(" | "), F.coalesce("code_value", F.lit("-")), F.lit(" | "), "advice", F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("audit_id").agg(F.concat(F.lit("| 参数 | 论文 | 代码 | 建议 |\n|-|-|-|-|\n"), body).alias("pack"))


def findings_json(findings: DataFrame) -> DataFrame:
    return findings.select("audit_id", "seq", F.to_json(F.struct(*findings.columns)).alias("json"))


def findings_from_json(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", like.schema).alias("f")).select("f.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """One text file part for each audit's partition; the audit is the folder."""
    reports.select("audit_id", F.col("report").alias("value")).write.partitionBy("audit_id").mode("overwrite").text(path)


def masked(lines: DataFrame, column: str = "line") -> DataFrame:
    """Report lines with timings and counters masked, so that two runs can be compared."""
    return lines.withColumn(column, V.collapse_space(F.regexp_replace(F.regexp_replace(column, r"[0-9]+(\.[0-9]+)?\s*(s|秒|ms)\b", "<t>"), r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d)?", "<when>")))


def line_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lines (keys, line_no, line) that went or came between two masked runs: (keys, seq, kind, a, b, line), with their numbers on both sides. An inserted
    line changes none of those that follow."""
    return changes(masked(old), masked(new), keys).filter("kind <> ' '")
