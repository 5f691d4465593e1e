"""Findings: best evidence of each side, a full outer join on the parameter, status, risk, internal conflicts, results, image readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import RANGES, RISK_ORDER, TEXT_VALUED, category, display_name, importance, lookup
from ..functions import values as V
from .generic import tolerance_band

SIDE = ["raw_value", "num", "txt", "location", "file", "page", "line", "snippet", "channel"]
FINDING = ["audit_id", "key", "display", "category", "status", "confidence", "risk", "risk_ord", "risk_reason", "paper", "code", "extra", "note"]


def _side() -> Column:
    return F.struct(*SIDE)


def value_text(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}num").cast("string"), F.col(f"{prefix}txt"))


def _scored(evidence: DataFrame) -> DataFrame:
    """Evidence in code with ``rank``, the greater the stronger and the first of equals; null for what only tests or examples say, which is no evidence.
    Of the calls that fix a seed the one in an entry or solver file counts before that in plots or data."""
    known = F.col("num").isNotNull() | F.col("txt").isNotNull()
    name = F.lower(F.col("location"))
    call = F.when(F.col("form") == "seed", F.when(name.rlike("solve|train"), 3).when(name.rlike("plot|data"), -3).otherwise(0)).otherwise(0)
    scored = evidence.withColumn("_score", V.evidence_score(F.col("location"), known)).withColumn("_call", call)
    order = F.struct(F.col("_score").alias("score"), F.col("_call").alias("call"), (-F.col("ordinal")).alias("o"), "location", "raw_value", _side().alias("ev"))
    return scored.withColumn("rank", F.when(F.col("_score") >= 0, order)).drop("_score", "_call")


def best_code(evidence: DataFrame) -> DataFrame:
    """The strongest evidence of each key."""
    return _scored(evidence).filter("rank is not null").groupBy("audit_id", "key").agg(F.max("rank").alias("r")).select("audit_id", "key", F.col("r.ev").alias("code"))


def both_sides(paper: DataFrame, code: DataFrame) -> DataFrame:
    """One row for each key: the first claim, the strongest evidence in code with its score, the number of values that are usual in code, and the places of
    each side where its distinct values are first seen. Evidence is read once: it is combined by value, then by key, map-side both times."""
    first = F.struct("ordinal", "location", _side().alias("ev"))
    none = lambda of: F.when(F.lit(False), of)
    columns = ["audit_id", "key", "_code", "_v", "_claim", "_rank", "_first", "_usual"]
    usual = ~F.col("excluded") & (F.col("form") != "seed")
    in_code = usual & ~V.is_aux(F.col("location")) & ~F.contains(F.col("location"), F.lit("[cell"))
    scored = _scored(code).withColumn("_code", F.lit(True)).withColumn("_v", value_text()).withColumn("_rank", F.col("rank")).withColumn("_usual", F.coalesce(usual, F.lit(False)) & F.col("_v").isNotNull())
    claim = F.struct("ordinal", "location", "raw_value", _side().alias("ev"))
    scored = scored.withColumn("_first", F.when(in_code & F.col("_v").isNotNull(), first)).withColumn("_claim", none(claim)).select(*columns)
    claims = paper.withColumn("_code", F.lit(False)).withColumn("_v", value_text()).withColumn("_first", F.when(~F.col("excluded") & F.col("_v").isNotNull(), first))
    claims = claims.withColumn("_rank", F.lit(None).cast(scored.schema["_rank"].dataType)).withColumn("_claim", claim).withColumn("_usual", F.lit(False)).select(*columns)
    values = claims.unionByName(scored).groupBy("audit_id", "key", "_code", "_v").agg(F.min("_claim").alias("_claim"), F.max("_rank").alias("_rank"), F.min("_first").alias("_first"), F.max("_usual").alias("_usual"))
    of = lambda code: F.array_sort(F.collect_list(F.when(F.col("_code") == code, F.col("_first"))))
    grouped = values.groupBy("audit_id", "key").agg(F.min("_claim").alias("_claim"), F.max("_rank").alias("_rank"), F.count_if("_usual").alias("code_values"), of(False).alias("paper_all"), of(True).alias("code_all"))
    return grouped.select("audit_id", "key", F.col("_claim.ev").alias("paper"), F.col("_rank.ev").alias("code"), F.col("_rank.score").alias("code_score"), "code_values", "paper_all", "code_all")


def same_value(a: str, b: str) -> Column:
    """One comparison for classifying and for replaying: equal values, or texts of which one holds the other."""
    text = lambda s: F.coalesce(F.col(f"{s}.txt"), F.col(f"{s}.raw_value"))
    numeric = F.col(f"{a}.num").isNotNull() | F.col(f"{b}.num").isNotNull()
    return F.coalesce(V.values_equal(F.col(f"{a}.raw_value"), F.col(f"{b}.raw_value")), F.lit(False)) | (~numeric & V.text_match(text(a), text(b)))


def param_status() -> Column:
    dynamic = F.col("code.num").isNull() & F.col("code.txt").isNull()
    seed_only = F.col("key") == "seed"
    return (
        F.when(F.col("paper").isNull() & F.col("code").isNull(), F.lit(None).cast("string"))
        .when(F.col("code").isNull(), F.when(seed_only, "not_fixed").otherwise("missing_in_code"))
        .when(F.col("paper").isNull(), "missing_in_paper")
        .when(dynamic, "unverifiable")
        .when(same_value("paper", "code"), "consistent")
        .otherwise("inconsistent")
    )


def risk_of(status: Column, key: Column, *, downgraded: Column, one_carrier: Column, code_side: Column) -> Column:
    """(risk, reason) of a finding about a parameter."""
    weight = importance(key)
    row = lambda risk, reason: F.struct((F.lit(risk) if isinstance(risk, str) else risk).alias("risk"), F.lit(reason).alias("reason"))
    return (
        F.when(status == "consistent", row("none", ""))
        .when((status == "inconsistent") & (key == "seed"), row("low", "随机种子取值与论文不一致: 结果可复跑, 但不是论文的那一次"))
        .when((status == "inconsistent") & downgraded, row("low", "代码中有多个候选取值, 只比对了首选实现, 不足以断定与论文矛盾"))
        .when(status == "inconsistent", row(weight, "取值与论文不一致"))
        .when((status == "missing_in_paper") & ((key == "seed") | (weight == "low")), row("low", "论文未声明, 代码中已有确定取值"))
        .when(status == "missing_in_paper", row("medium", "代码实现了该参数但论文未声明, 他人无法照论文复现"))
        .when((status == "missing_in_code") & (weight == "low"), row("low", "论文有声明, 代码未见显式实现, 可能由框架默认值提供"))
        .when(status == "missing_in_code", row("medium", "论文有声明, 代码中未找到, 可能由外部配置注入"))
        .when(status == "not_fixed", row("medium", "论文要求固定随机性而代码未固定, 结果无法稳定复现"))
        .when(status == "unverifiable", row("low", "取值由运行时决定, 静态分析不下结论"))
        .when((status == "internal_inconsistent") & code_side & one_carrier, row("medium", "同一代码文件内有多个不同取值, 实际生效值不明确"))
        .when((status == "internal_inconsistent") & code_side, row("low", "多个文件中取值不同, 未必是同一套配置"))
        .otherwise(row("low", "论文内部多处表述不同, 需人工确认是否同一实验"))
    )


def _finished(df: DataFrame, confidence: str) -> DataFrame:
    blank = F.array().cast(df.select(F.array("paper").alias("x")).schema["x"].dataType)
    out = df.withColumn("display", F.when(F.col("key").startswith("result_"), F.concat(F.lit("Result: "), F.substring("key", 8, 200))).otherwise(display_name(F.col("key")))).withColumn("category", category(F.col("key")))
    if "extra" not in df.columns:
        out = out.withColumn("extra", blank)
    return out.withColumn("confidence", F.lit(confidence)).withColumn("risk_ord", lookup(F.col("risk"), RISK_ORDER)).select(*FINDING)


def _compared() -> Column:
    """What a row of ``both_sides`` with its status ``_status`` says where a side holds usable evidence."""
    status = F.col("_status")
    vague = (F.col("code_values") > 1) & (F.col("key").isin(*TEXT_VALUED) | (F.col("code_score") < 6)) & (F.col("key") != "seed")
    risk = risk_of(status, F.col("key"), downgraded=vague, one_carrier=F.lit(False), code_side=F.lit(False))
    note = F.when((status == "inconsistent") & vague, F.concat(F.lit("代码中存在 "), "code_values", F.lit(" 个不同取值，本次取首选实现比对；请以实际运行配置为准"))).otherwise("")
    return V.bound(risk, lambda r: F.when(status.isNotNull(), F.struct(status.alias("status"), r["risk"].alias("risk"), r["reason"].alias("risk_reason"), F.col("paper").alias("paper"), F.col("code").alias("code"), F.array().cast(_SIDES).alias("extra"), note.alias("note"))))


def _clashing() -> Column:
    """What a row of ``both_sides`` says where one side holds several values."""

    def told(every: str, code: bool) -> Column:
        files = F.size(F.array_distinct(F.array_compact(F.transform(every, lambda x: F.coalesce(x["ev"]["file"], x["location"])))))  # of distinct values; a paper is one carrier
        risk = risk_of(F.lit("internal_inconsistent"), F.col("key"), downgraded=F.lit(False), one_carrier=files == 1, code_side=F.lit(code))
        described = F.array_join(F.transform(F.slice(every, 1, 4), lambda x: F.concat(F.coalesce(x["ev"]["num"].cast("string"), x["ev"]["txt"]), F.lit(" @ "), x["location"])), "; ")
        said = F.concat(F.lit(("代码" if code else "论文") + "内部多处声明互不一致: "), described)
        first, more = F.get(every, F.lit(0))["ev"], F.transform(F.slice(every, 2, 3), lambda x: x["ev"])
        return V.bound(risk, lambda r: F.when(F.size(every) > 1, F.struct(lookup(r["risk"], RISK_ORDER).alias("o"), F.lit(int(code)).alias("s"), r["risk"].alias("risk"), r["reason"].alias("reason"), said.alias("said"), first.alias("first"), more.alias("more"))))

    def merged(sides: Column) -> Column:
        worst, of = F.array_min(sides), lambda s: F.get(F.filter(sides, lambda x: x["s"] == s), F.lit(0))["first"]
        notes = F.array_join(F.array_sort(F.transform(sides, lambda x: x["said"])), "；")
        extra = F.flatten(F.transform(sides, lambda x: x["more"]))
        return F.when(F.size(sides) > 0, F.struct(F.lit("internal_inconsistent").alias("status"), worst["risk"].alias("risk"), worst["reason"].alias("risk_reason"), of(0).alias("paper"), of(1).alias("code"), extra.alias("extra"), notes.alias("note")))

    return V.bound(F.array_compact(F.array(told("paper_all", False), told("code_all", True))), merged)


_SIDES = "array<struct<raw_value:string,num:double,txt:string,location:string,file:string,page:int,line:int,snippet:string,channel:string>>"


def _told(both: DataFrame, *kinds: Column) -> DataFrame:
    said = both.withColumn("_status", param_status()).withColumn("_f", F.array(*kinds))
    # the outer form, as Spark would else filter by the array before it is made, and so make it three times
    return _finished(said.select("audit_id", "key", F.inline_outer("_f")).filter("status is not null"), "confirmed")


def align_params(paper: DataFrame, code: DataFrame) -> DataFrame:
    """One row for each parameter that a side holds usable evidence of."""
    return _told(both_sides(paper, code), _compared())


def conflicts(paper: DataFrame, code: DataFrame) -> DataFrame:
    """A row beside the comparison for each key of which one side holds several values."""
    return _told(both_sides(paper, code), _clashing())


def compare(paper: DataFrame, code: DataFrame) -> DataFrame:
    """The rows of ``align_params`` and of ``conflicts``, from one pass."""
    return _told(both_sides(paper, code), _compared(), _clashing())


def align_results(claimed: DataFrame, measured: DataFrame) -> DataFrame:
    """Claimed metrics against measured ones; a metric that only one side has is no row."""
    paper = claimed.select("audit_id", "key", _side().alias("paper"), "num")
    side = F.struct(
        F.col("value").cast("string").alias("raw_value"), F.col("value").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit("用户上传实验结果").alias("location"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("line"), F.concat("metric", F.lit(" = "), "value").alias("snippet"), F.lit("result").alias("channel"),
    )
    actual = measured.select("audit_id", F.col("metric").alias("key"), side.alias("code"), "value")
    rows = paper.join(actual, ["audit_id", "key"])
    rows = rows.withColumn("risk", tolerance_band(F.col("num"), F.col("value"))).withColumn("status", F.when(F.col("risk") == "none", "consistent").otherwise("inconsistent"))
    reason = F.when(F.col("risk") == "none", "").otherwise("实测指标偏离论文所声明的数值, 结果未能重现")
    rows = rows.withColumn("key", F.concat(F.lit("result_"), "key")).withColumn("risk_reason", reason).withColumn("note", F.lit(""))
    return _finished(rows, "confirmed")


def stable_readings(readings: DataFrame) -> DataFrame:
    """Values that both runs of a reading agree on, by parameter and value."""
    named = readings.withColumn("key", V.canonical_key(F.col("name"))).filter("key is not null")
    num = V.normalize_number(F.col("value"))
    valued = named.withColumn("num", num).withColumn("txt", F.when(num.isNull(), V.compare_form(F.col("value")))).withColumn("v", F.coalesce(F.col("num").cast("string"), "txt"))
    # both runs come together by parameter and value; a number is read once, so that its range is asked for beside it and not as a filter before
    sound = F.coalesce(V.within_range(F.col("key"), F.col("num"), RANGES), F.lit(True))
    rows = valued.dropna(subset=["paper_id", "page_no", "value"]).withColumn("_sound", sound)
    second = F.max((F.col("run") == 2) & F.col("_sound")).over(Window.partitionBy("paper_id", "page_no", "key", "v"))
    return rows.withColumn("_second", second).filter("run = 1 and _sound and _second").drop("_sound", "_second")


def align_images(readings: DataFrame, paper: DataFrame, code: DataFrame) -> DataFrame:
    """Readings of images for keys that no text gave: clues of their own, outside the score."""
    place = F.struct(
        F.col("value").alias("raw_value"), "num", "txt", F.concat(F.lit("Page "), "page_no", F.lit(" · "), "region_kind").alias("location"), F.lit(None).cast("string").alias("file"),
        F.col("page_no").alias("page"), F.lit(None).cast("int").alias("line"), F.col("evidence_text").alias("snippet"), F.lit("vision").alias("channel"),
    )
    seen = stable_readings(readings).groupBy("audit_id", "key").agg(F.min_by(place, F.struct("page_no", "v", "name")).alias("paper")) if "audit_id" in readings.columns else None
    if seen is None:
        raise ValueError("readings need an audit_id")
    alone = seen.join(paper.select("audit_id", "key").distinct(), ["audit_id", "key"], "left_anti").join(best_code(code), ["audit_id", "key"], "left")
    known = F.col("code.num").isNotNull() | F.col("code.txt").isNotNull()
    status = F.when(F.coalesce(known, F.lit(False)), F.when(same_value("paper", "code"), "consistent").otherwise("inconsistent")).otherwise("missing_in_code")
    rows = alone.withColumn("status", status).withColumn("risk", F.when(F.col("status") == "consistent", "none").otherwise("low")).withColumn("risk_reason", F.lit("")).withColumn("note", F.lit("该论文值由 AI 读图获得(图像/扫描页), 未经文本层验证, 请人工核对原图"))
    return _finished(rows.withColumn("code", F.when(F.col("status") != "missing_in_code", F.col("code"))), "inferred")


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report: risk, key, and the conflict before the comparison."""
    first = F.when(F.col("status") == "internal_inconsistent", 0).otherwise(1)
    w = Window.partitionBy("audit_id").orderBy("risk_ord", "key", first, "confidence", "status")
    return findings.withColumn("seq", F.row_number().over(w))
