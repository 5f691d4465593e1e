"""Checks of the audit itself: evidence holds its value, conclusions replay, coverage, the parameter matrix, what to check by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import RISK_ORDER, dim_param, lookup
from ..functions import values as V
from .align import param_status, same_value
from .generic import tolerance_band


def snippet_contains(snippet: Column, raw: Column) -> Column:
    """Whether a snippet shows a value: literally, without digit separators, in comparable form, or as any equal number."""
    bare = lambda x: F.regexp_replace(x, "[,_](?=[0-9])", "")
    numbers = F.regexp_extract_all(bare(snippet), F.lit(r"((?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    value = V.normalize_number(raw)
    literal = F.contains(snippet, raw) | F.contains(bare(snippet), bare(raw)) | F.contains(V.compare_form(snippet), V.compare_form(raw))
    return F.coalesce(literal | F.exists(numbers, lambda x: F.coalesce(V.numbers_equal(x.try_cast("double"), value), F.lit(False))), F.lit(False))


def selfcheck(findings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add verified and verify_note. ``lengths`` are (audit_id, file, n_lines); the comparison is that of the findings."""
    files = lengths.select(F.col("audit_id").alias("_audit"), F.col("file").alias("_file"), "n_lines")
    rows = findings.join(files, (F.col("audit_id") == F.col("_audit")) & (F.col("code.file") == F.col("_file")), "left")
    shown = lambda s: F.when(F.col(s).isNull() | (F.col(f"{s}.num").isNull() & F.col(f"{s}.txt").isNull()), True).otherwise(snippet_contains(F.col(f"{s}.snippet"), F.col(f"{s}.raw_value")))
    bounds = F.coalesce(F.col("code.line") <= F.col("n_lines"), F.lit(True))
    result = F.col("key").startswith("result_")
    again = F.when(result, F.when(tolerance_band(F.col("paper.num"), F.col("code.num")) == "none", "consistent").otherwise("inconsistent")).otherwise(param_status())
    compared = F.col("status").isin("consistent", "inconsistent")
    replayed = F.when(compared, again == F.col("status")).otherwise(True)
    note = V.first_reason([("论文证据片段中未见该取值", ~shown("paper")), ("代码证据片段中未见该取值", ~shown("code")), ("代码行号超出文件范围", ~bounds), ("结论无法由证据重算得到", ~replayed)])
    return rows.withColumn("verify_note", F.coalesce(note, F.lit(""))).withColumn("verified", F.col("verify_note") == "").drop("_audit", "_file", "n_lines")


def coverage(audits: DataFrame, pages: DataFrame, mentioned: DataFrame, valued: DataFrame, files: DataFrame, failed: DataFrame, checked: DataFrame, read_pages: DataFrame) -> DataFrame:
    """How much of an audit's material was looked at, and the confidence that follows; without pages nothing is covered."""
    thin = V.is_thin(F.coalesce("text", F.lit("")))
    page = pages.select("paper_id", "page_no", thin.alias("thin")).join(read_pages.select("paper_id", "page_no", F.lit(True).alias("read")).distinct(), ["paper_id", "page_no"], "left")
    per_paper = page.groupBy("paper_id").agg(F.count("*").alias("pages_total"), F.count_if(~F.col("thin")).alias("pages_parsed"), F.count_if("thin").alias("pages_thin"), F.count_if(F.col("thin") & F.coalesce("read", F.lit(False))).alias("pages_read"))
    seen = mentioned.groupBy("paper_id").agg(F.count("*").alias("kinds_seen"))
    got = mentioned.join(valued.select(F.col("owner_id").alias("paper_id"), "key").distinct(), ["paper_id", "key"], "left_semi").groupBy("paper_id").agg(F.count("*").alias("kinds_valued"))
    code = files.groupBy("code_id").agg(F.count("*").alias("code_files"))
    bad = failed.groupBy("code_id").agg(F.countDistinct("file").alias("failed"))
    wrong = checked.groupBy("audit_id").agg(F.count_if(~F.col("verified")).alias("check_failed"))
    rows = audits.join(per_paper, "paper_id", "left").join(seen, "paper_id", "left").join(got, "paper_id", "left").join(code, "code_id", "left").join(bad, "code_id", "left").join(wrong, "audit_id", "left")
    rows = rows.fillna(0)
    covered = F.col("pages_parsed") + F.col("pages_read")
    page_ratio = F.when(F.col("pages_total") > 0, covered / F.col("pages_total")).otherwise(F.lit(0.0))
    kind_ratio = F.when(F.col("kinds_seen") > 0, F.col("kinds_valued") / F.col("kinds_seen"))
    loss = (
        F.when(page_ratio < 0.6, 25).when(page_ratio < 0.8, 12).otherwise(0)
        + F.least(F.lit(30), 10 * F.col("failed"))
        + F.when(kind_ratio < 0.4, 10).otherwise(0)
        + F.when(F.col("check_failed") > 0, 20).otherwise(0)
    )
    score = F.greatest(F.lit(10), 100 - loss).cast("int")
    level = F.when(score >= 85, "高").when(score >= 65, "中").otherwise("低")
    return rows.select(
        "audit_id", "pages_total", "pages_parsed", covered.alias("pages_covered"), "pages_thin", "kinds_seen", "kinds_valued", "code_files", (F.col("code_files") - F.col("failed")).alias("code_ok"),
        F.bround(page_ratio, 3).alias("page_ratio"), F.bround(kind_ratio, 3).alias("kind_ratio"), score.alias("confidence_score"), level.alias("level"),
    )


def channels(evidence: DataFrame) -> DataFrame:
    """The channels that gave each parameter of a paper."""
    return evidence.groupBy("owner_id", "key").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def param_matrix(spark: SparkSession, paper: DataFrame, images: DataFrame, code: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Every parameter against every carrier, for parameters that some carrier holds; inputs have audit_id and key."""
    audits = paper.select("audit_id").union(code.select("audit_id")).union(images.select("audit_id")).union(mentioned.select("audit_id")).distinct()
    has = lambda df, name: df.select("audit_id", "key", F.lit(True).alias(name)).distinct()
    grid = paper.select("audit_id", "key").union(code.select("audit_id", "key")).union(images.select("audit_id", "key")).union(mentioned.select("audit_id", "key")).distinct()
    out = grid.join(dim_param(spark).select("key", "display"), "key").join(audits, "audit_id", "left_semi")
    for df, name in ((paper, "in_paper"), (images, "in_image"), (code, "in_code"), (mentioned, "mentioned")):
        out = out.join(has(df, name), ["audit_id", "key"], "left")
    return out.fillna(False, ["in_paper", "in_image", "in_code", "mentioned"])


def manual_checks(findings: DataFrame, failed: DataFrame, unsupported: DataFrame, thin: DataFrame, gaps: DataFrame, rejected: DataFrame, regions: DataFrame) -> DataFrame:
    """What a person should look at: level 0 may change a conclusion, 1 wants a second look, 2 is good to know. All inputs have audit_id;
    ``thin`` has page_no and read, ``regions`` the numbers of image regions and of those that were read, and whether reading was enabled."""
    item = lambda df, kind, level, what: df.select("audit_id", F.lit(kind).alias("kind"), F.lit(level).alias("level"), what.alias("what"))
    side = lambda s: F.coalesce(F.col(f"{s}.raw_value"), F.lit("—"))
    pages = thin.groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_set("page_no")), ", ").alias("all"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("read"), F.col("page_no")))), ", ").alias("unread"))
    of = lambda status: findings.filter(F.col("status") == status)
    images = findings.filter("paper.channel = 'vision' or code.channel = 'vision'")
    parts = [
        item(findings.filter("not verified"), "selfcheck", 0, F.concat("display", F.lit(": "), "verify_note")),
        item(images, "image_only", 1, F.concat("display", F.lit(" @ "), F.coalesce("paper.location", "code.location"))),
        item(of("unverifiable"), "unverifiable", 1, F.concat("display", F.lit(": "), side("code"))),
        item(of("internal_inconsistent"), "contradiction", 1, F.concat("display", F.lit(": "), F.coalesce("note", F.lit("")))),
        item(regions.filter("regions > 0 and not enabled"), "images_off", 1, F.col("regions").cast("string")),
        item(regions.filter("enabled and regions_read < regions"), "images_over_budget", 2, F.concat("regions_read", F.lit("/"), "regions")),
        item(failed, "failed_file", 1, F.concat("file", F.lit(": "), "reason")),
        item(unsupported, "unsupported_file", 2, F.col("file")),
        item(pages.filter("unread <> ''"), "thin_pages", 1, F.concat(F.lit("Page "), "all", F.lit("; unread "), "unread")),
        item(pages.filter("unread = ''"), "thin_pages_read", 2, F.concat(F.lit("Page "), "all")),
        item(gaps.groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys")), "no_value", 1, F.col("keys")),
        item(rejected, "rejected", 2, F.concat("key", F.lit(" = "), "value", F.lit(" @ "), "location")),
        item(of("missing_in_paper"), "missing_in_paper", 2, F.concat("display", F.lit(" @ "), F.coalesce("code.location", F.lit("—")))),
        item(of("missing_in_code"), "missing_in_code", 1, F.concat("display", F.lit(": "), side("paper"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("audit_id", "level", "kind", "what")


def worst_first(findings: DataFrame) -> list[Column]:
    return [lookup(F.col("risk"), RISK_ORDER), F.col("key")]


__all__ = ["channels", "coverage", "manual_checks", "param_matrix", "same_value", "selfcheck", "snippet_contains", "worst_first"]
