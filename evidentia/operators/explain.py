"""What a reader is told: explanations of findings, prompts for an outside model, excerpts, lists with their lengths, outcomes of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import patterns as P
from ..dims import PARAMS, lookup
from ..functions import values as V
from ..plans.planner import cached_calls
from .extract_paper import alias_pattern

#: The ratio of two values from which it is told; sentences after which no further page is quoted; characters of a quotation.
RATIO, EXCERPTS, EXCERPT_CHARS = 5.0, 6, 4000
#: Pages that are read again for a parameter, and the lengths of the lists of thin pages, open parameters and files.
READ_AGAIN, THIN, OPEN, FILES = 2, 20, 15, 20

#: One text for each kind of finding; {ratio} is the gap of the two values where it is large.
TEMPLATES = {
    "result": "实测指标偏离了论文的数值。先核对列出的参数差异, 全部消除之后再重跑一次。",
    "unverifiable": "代码里这个取值要到运行时才知道, 静态检查只能停在这里。请打印或记录实际取值。",
    "internal": "同一份材料里给出了几个不同的取值。若不是有意的对照实验, 请先统一成一个。",
    "missing_in_code": "论文写了这个参数, 代码里却找不到。它可能来自默认值或外部配置, 请写进代码。",
    "missing_in_paper": "代码用到了这个取值, 论文没有写。只读论文的人无法照做, 请在论文中补上。",
    "learning_rate": "两边的学习率不同{ratio}, 收敛过程会随之改变。请以论文的取值重新训练并比较。",
    "seed": "没有固定随机种子, 每次运行都会得到不同的结果。请在入口处设定种子。",
    "dataset": "两边使用的数据不同, 指标因此不能直接比较。请确认数据的名称和版本。",
    "other": "代码与论文的取值不同{ratio}, 实验条件已经改变。请改回论文的取值后重跑。",
}


def explanations(findings: DataFrame) -> DataFrame:
    """Findings that are not consistent with the kind of their explanation, the ratio of both values where it is at least
    ``RATIO``, and the text."""
    a, b = F.col("paper.num"), F.col("code.num")
    ratio = F.greatest(F.abs(a), F.abs(b)) / F.least(F.abs(a), F.abs(b))
    told = F.when((a != 0) & (b != 0) & (ratio >= RATIO), ratio)
    kind = (
        F.when(F.col("key").startswith("result_"), "result").when(F.col("status") == "unverifiable", "unverifiable").when(F.col("status") == "internal_inconsistent", "internal")
        .when(F.col("status").isin("missing_in_code", "missing_in_paper"), F.col("status")).when(F.col("key").isin("learning_rate", "seed", "dataset"), F.col("key")).otherwise("other")
    )
    rows = findings.filter("status <> 'consistent'").withColumn("kind", kind).withColumn("ratio", F.when(kind.isin("learning_rate", "other"), told))
    gap = F.coalesce(F.concat(F.lit(", 相差约 "), F.format_number("ratio", 1), F.lit(" 倍")), F.lit(""))
    return rows.select("audit_id", "key", "seq", "kind", "ratio", F.replace(lookup(F.col("kind"), TEMPLATES), F.lit("{ratio}"), gap).alias("explanation"))


def prompts(findings: DataFrame) -> DataFrame:
    """(id, mode, prompt) that asks an outside model to explain a finding; what was found is given and not up to the model."""
    side = lambda s, name: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(f"{s}.raw_value"), F.lit(" @ "), F.col(f"{s}.location"), F.lit(" | "), F.coalesce(F.col(f"{s}.snippet"), F.lit(""))), F.lit(f"{name}: -"))
    text = F.concat_ws("\n", F.lit("用三句话以内说明下面这条已核实的差异对复现的影响, 可能的原因, 以及怎样改正。只写正文。"), F.concat(F.lit("参数: "), "display"), F.concat(F.lit("结论: "), "status", F.lit(" / "), "risk"), side("paper", "论文"), side("code", "代码"))
    return findings.filter("status <> 'consistent'").select(F.to_json(F.struct("audit_id", "key", "seq")).alias("id"), F.lit("explain").alias("mode"), text.alias("prompt"), "audit_id", "key", "seq")


def explain(findings: DataFrame, cache: DataFrame | None = None, call: Callable[[int, str], str] | None = None, tries: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """(explanations with their source, rows to add to the cache): what the cache knows, else what a model answers within some
    tries, else the template."""
    plain = explanations(findings)
    if call is None or cache is None:
        return plain.withColumn("source", F.lit("template")), None
    asked = prompts(findings)
    answers, fresh = cached_calls(asked.select("id", "mode", "prompt"), cache, call, tries)
    said = asked.select("id", "audit_id", "key", "seq").join(answers.select("id", "answer"), "id").select("audit_id", "key", "seq", "answer")
    rows = plain.join(said, ["audit_id", "key", "seq"], "left")
    return rows.withColumn("source", F.when(F.col("answer").isNull(), "template").otherwise("model")).withColumn("explanation", F.coalesce("answer", "explanation")).drop("answer"), fresh


def _names(key: Column, text: Column) -> Column:
    """Whether a text names the parameter of a key."""
    said = F.lit(False)
    for k in PARAMS:
        said = said | ((key == k) & text.rlike(alias_pattern(k)))
    return said


def excerpts(pages: DataFrame, gaps: DataFrame, stop: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> DataFrame:
    """(paper_id, key, excerpts): the sentences that name an open parameter, page by page until ``stop`` are found, as one text
    of at most ``chars`` characters, which is what a prompt holds."""
    sentence = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({P.SENTENCE})"), F.lit(1)))
    asked = pages.select("paper_id", "page_no", "text").join(gaps.select("paper_id", "key").hint("merge"), "paper_id")  # both grow with the papers
    found = asked.select("paper_id", "key", "page_no", sentence.alias("s")).filter(_names(F.col("key"), F.col("s")))
    page = found.groupBy("paper_id", "key", "page_no").agg(F.collect_list("s").alias("ss"))
    before = Window.partitionBy("paper_id", "key").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = page.withColumn("known", F.coalesce(F.sum(F.size("ss")).over(before), F.lit(0))).filter(F.col("known") < stop)
    quoted = kept.withColumn("t", F.array_join(F.transform("ss", lambda s: F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("] "), s)), "\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda x: x["t"]), "\n")
    return quoted.groupBy("paper_id", "key").agg(F.substring(joined, 1, chars).alias("excerpts"))


def pages_to_read(pages: DataFrame, gaps: DataFrame, most: int = READ_AGAIN) -> DataFrame:
    """The first pages that name an open parameter, ``most`` for each: these are read again as images."""
    named = pages.select("paper_id", "page_no", F.coalesce("text", F.lit("")).alias("t")).join(gaps.select("paper_id", "key").hint("merge"), "paper_id").filter(_names(F.col("key"), F.col("t")))
    order = Window.partitionBy("paper_id", "key").orderBy("page_no")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("paper_id", "key", "page_no", "rank")


def coverage_lists(audits: DataFrame, pages: DataFrame, open_kinds: DataFrame, failed: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Lists of a coverage report, each with its full number and no more than its length: thin pages, open parameters, files that
    failed and files that cannot be read. ``failed`` and ``unsupported`` have audit_id and file."""
    thin = pages.filter(V.is_thin(F.coalesce("text", F.lit("")))).join(audits.select("audit_id", "paper_id"), "paper_id").select("audit_id", F.lit("thin").alias("list"), F.format_string("%09d", "page_no").alias("o"), F.col("page_no").cast("string").alias("item"))
    kinds = open_kinds.join(audits.select("audit_id", "paper_id"), "paper_id").select("audit_id", F.lit("open").alias("list"), F.col("key").alias("o"), F.col("key").alias("item"))
    files = lambda df, name: df.select("audit_id", F.lit(name).alias("list"), F.col("file").alias("o"), F.col("file").alias("item"))
    every = thin.unionByName(kinds).unionByName(files(failed, "failed")).unionByName(files(unsupported, "unsupported")).distinct()
    length = lookup(F.col("list"), {"thin": THIN, "open": OPEN, "failed": FILES, "unsupported": FILES})
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("audit_id", "list").orderBy("o"))).withColumn("shown", F.col("place") <= length)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("o", "item")))), lambda x: x["item"])
    return placed.groupBy("audit_id", "list").agg(F.count("*").alias("n"), items.alias("items"))


def outcomes(coverage: DataFrame, findings: DataFrame, traces: DataFrame, patches: DataFrame, fills: DataFrame) -> DataFrame:
    """(audit_id, step, outcome): what each step of an audit did, in figures; ``fills`` have audit_id and ok."""
    count = lambda df, where: df.groupBy("audit_id").agg(F.count("*").alias("n"), F.count_if(where).alias("k"))
    line = lambda df, step, text: df.select("audit_id", F.lit(step).alias("step"), text.alias("outcome"))
    parts = [
        line(coverage, "parse_paper", F.format_string("%d/%d 页, 参数 %d/%d 种有取值", "pages_parsed", "pages_total", "kinds_valued", "kinds_seen")),
        line(coverage, "analyze_code", F.format_string("%d/%d 个文件可解析", "code_ok", "code_files")),
        line(count(findings, F.col("status") != "consistent"), "align", F.format_string("%d 条发现, %d 条不一致或缺失", "n", "k")),
        line(count(traces, F.col("confidence") != "none"), "trace", F.format_string("%d 个参数, %d 个找到生效位置", "n", "k")),
        line(count(patches, F.col("status") == "proposed"), "patch", F.format_string("%d 个参数, %d 份草案", "n", "k")),
        line(count(fills, F.col("ok")), "fill_missing", F.format_string("%d 个候选, 采用 %d 个", "n", "k")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
