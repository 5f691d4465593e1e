"""Questions to a person, their answers, and the pack that repeats an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import RISK_ORDER, display_name, lookup

#: Conflicts and files that a person is asked about, an audit.
MOST_CONFLICTS, MOST_FILES = 5, 5

ADVICE = {
    "consistent": "论文与代码一致, 直接采用",
    "inconsistent": "以作者确认为准, 确认前不要沿用任何一侧",
    "missing_in_code": "在配置中补上论文声明的取值",
    "missing_in_paper": "采用代码取值, 并在记录中注明",
    "not_fixed": "补上固定随机种子的调用",
    "unverifiable": "实际运行并打印该取值",
    "internal_inconsistent": "先确认目标实验对应哪一个取值",
}


def build_questions(findings: DataFrame, missing: DataFrame, images: DataFrame, failed: DataFrame, most_conflicts: int | None = MOST_CONFLICTS, most_files: int | None = MOST_FILES, risks: tuple[str, ...] = ("high",)) -> DataFrame:
    """What only a person can answer, in the order of priority: conflicts of high risk (or of other ``risks`` too; the first few of the report), named
    parameters that no channel gave a value of, values read from images, and files that do not parse (the first few). None asks about all.
    ``missing`` and ``images`` have audit_id and key, ``failed`` has audit_id, file and reason."""
    first = lambda df, order, most: df if most is None else df.withColumn("_r", F.row_number().over(Window.partitionBy("audit_id").orderBy(*order))).filter(F.col("_r") <= most)
    ask = lambda df, kind, priority, mark, on, text: df.select("audit_id", F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.concat(F.lit(f"{mark}::"), on).alias("qid"), F.col(on).alias("key"), text.alias("question"))
    name = display_name(F.col("key"))
    worst = first(findings.filter((F.col("status") == "inconsistent") & F.col("risk").isin(*risks)), ["seq", "key"], most_conflicts)
    parts = [
        ask(worst, "conflict", 0, "conflict", "key", F.concat(name, F.lit(": 论文 "), F.coalesce("paper.raw_value", F.lit("-")), F.lit(" 与代码 "), F.coalesce("code.raw_value", F.lit("-")), F.lit(" 以哪个为准?"))),
        ask(missing.select("audit_id", "key").distinct(), "missing_value", 1, "missing", "key", F.concat(name, F.lit(": 论文提到但各通道均未取到取值, 实际取值是多少?"))),
        ask(images.select("audit_id", "key").distinct(), "image_inferred", 2, "vision", "key", F.concat(name, F.lit(": 读图所得取值与原图是否一致?"))),
        ask(first(failed, ["file"], most_files), "parse_failure", 3, "parse", "file", F.concat(F.lit("文件 "), "file", F.lit(" 未能解析, 是否影响结论?"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("audit_id", "priority", "qid")


def summarize(questions: DataFrame) -> DataFrame:
    return questions.groupBy("audit_id", "kind").agg(F.count("*").alias("n"))


def apply_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers; blank ones are no answers. Conclusions do not change by them."""
    given = answers.select("audit_id", "qid", F.trim("answer").alias("answer")).filter("answer <> ''")
    return questions.join(given, ["audit_id", "qid"])


def repro_rows(findings: DataFrame) -> DataFrame:
    """One row for each parameter: values of both sides, statuses and advice without repetition, the gravest first."""
    advice = lookup(F.col("status"), ADVICE, "")
    item = F.struct(lookup(F.col("risk"), RISK_ORDER).alias("o"), "seq", "status", advice.alias("advice"), F.col("paper.raw_value").alias("p"), F.col("code.raw_value").alias("c"), "risk", "display")
    rows = findings.groupBy("audit_id", "key").agg(F.array_sort(F.collect_list(item)).alias("f"))
    of = lambda c: F.transform("f", lambda x: x[c])
    first = lambda c: F.get(F.array_compact(of(c)), F.lit(0))
    return rows.select("audit_id", "key", first("display").alias("display"), first("p").alias("paper_value"), first("c").alias("code_value"), F.array_join(F.array_distinct(of("status")), "; ").alias("status"), F.array_join(F.array_distinct(of("advice")), "; ").alias("advice"), first("risk").alias("risk"))


def with_ranks(rows: DataFrame, k: int = 15) -> DataFrame:
    """Rows of the pack with the place of the ``k`` gravest open risks of each audit; null for the others."""
    open_ = F.coalesce(F.col("risk") != "none", F.lit(False))
    w = Window.partitionBy("audit_id", open_).orderBy(lookup(F.col("risk"), RISK_ORDER), "display", "key")
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("rank", F.when(open_ & (F.col("rank") <= k), F.col("rank")))


def repro_risks(rows: DataFrame, k: int = 15) -> DataFrame:
    """The open risks of each audit, gravest first."""
    return with_ranks(rows, k).filter("rank is not null")
