"""Filling parameters that a paper names but gives no plain value of: a ladder of proposals behind one gate."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import patterns as P
from ..dims import RANGES, TEXT_VALUED
from ..functions import values as V
from ..functions.names import NameIndex, bounded
from .verify import snippet_contains

NEAR, NEGATED, NEGATED_IN_SCAN = 45, 18, 25


def missing(mentioned: DataFrame, evidence: DataFrame) -> DataFrame:
    """(paper_id, key) that are named but have no value."""
    return mentioned.join(evidence.select(F.col("owner_id").alias("paper_id"), "key").distinct(), ["paper_id", "key"], "left_anti")


def in_distribution_call(before: str) -> bool:
    """Whether a text ends inside the arguments of a sampling function; its last 48 characters are looked at."""
    part, depth = before[-48:], 0
    for i in range(len(part) - 1, -1, -1):
        depth += (part[i] == ")") - (part[i] == "(")
        if depth < 0:
            return re.search(P.DISTRIBUTION, part[:i]) is not None
    return False


@F.pandas_udf(T.BooleanType())
def inside_distribution(before: pd.Series) -> pd.Series:
    return before.map(lambda b: in_distribution_call(b or ""))


_INDEX: list[NameIndex] = []


def _names() -> NameIndex:
    if not _INDEX:
        _INDEX.append(NameIndex())
    return _INDEX[0]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each sentence that names a parameter the numbers near the name: (level, value, before, after, sentence)."""
    sentence, number = re.compile(P.SENTENCE), re.compile(P.NUM_B)
    index = _names()
    literal = lambda alias: "(?i)" + bounded(alias)
    separators = re.compile(r"^[\s×xX*\-–—/·=:]*$")
    connector = re.compile(P.GAP_CONNECTOR)
    digit = re.compile(r"\d")  # every number has one
    for pdf in batches:
        rows = []
        for paper, page, text, keys in zip(pdf["paper_id"], pdf["page_no"], pdf["text"], pdf["keys"], strict=True):
            text, wanted = text or "", {k for k in keys if k not in TEXT_VALUED}
            # of names that begin at one place the longest is meant
            named = sorted((start, -len(index.entries[i][1]), i) for start, _, i in index.hits(text) if index.entries[i][0] in wanted)
            begins = [start for start, _, _ in named]
            for s in sentence.finditer(text):
                first: dict[str, re.Match[str]] = {}
                for start, _, i in named[bisect_left(begins, s.start()) : bisect_left(begins, s.end())]:
                    key = index.entries[i][0]
                    if key not in first and (m := index.pattern(i, "literal", literal).match(s[0], start - s.start())):
                        first[key] = m
                for key in keys:
                    hit = first.get(key)
                    if hit is None:
                        continue
                    head, tail = s[0][: hit.start()], s[0][hit.end() :]
                    after = number.search(tail) if digit.search(tail) else None
                    last = None
                    for last in number.finditer(head) if digit.search(head) else ():
                        pass
                    for m, gap, offset in ((after, tail[: after.start()] if after else "", hit.end()), (last, head[last.end() :] if last else "", 0)):
                        if m is None:
                            continue
                        level = 1 if separators.match(gap) else 2 if len(gap) <= NEAR and connector.search(gap) else 0
                        if level:
                            at, end = offset + m.start(), offset + m.end()
                            rows.append((paper, page, key, level, m[1], s[0][:at], s[0][end:], head[-NEGATED_IN_SCAN:], s[0]))
        yield pd.DataFrame(rows, columns=["paper_id", "page_no", "key", "level", "value", "before", "after", "head", "evidence"]).astype({"page_no": "int32", "level": "int32"})


def scan_candidates(pages: DataFrame, gaps: DataFrame) -> DataFrame:
    """Numbers near the names of missing parameters, those that a guard refuses aside."""
    keys = gaps.groupBy("paper_id").agg(F.collect_set("key").alias("keys"))
    found = pages.select("paper_id", "page_no", "text").join(keys.hint("merge"), "paper_id").mapInPandas(_scan, "paper_id string, page_no int, key string, level int, value string, before string, after string, head string, evidence string")
    number = F.col("before").rlike(r"[图表式第条]\s*$") | F.col("after").rlike(r"^[_,]\d")
    refused = F.col("head").rlike(f"(?:{P.NEGATION})[^.。]{{0,{NEGATED}}}$") | F.col("after").rlike(r"^\s*[-–—~]\s*\d") | F.col("before").rlike(r"[-–—~]\s*$") | number
    return found.filter(~refused & ~F.substring(F.col("before"), -20, 20).rlike(P.FREQUENCY))


def _negated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages (with collapsed white space) and keys whose names a negation stands before."""
    index = _names()
    said = re.compile(r"(?ai)\b(?:no|not|without|never|omit\w*|disable\w*)\b|不使用|未使用|没有使用|未采用|不采用|无需|不含")
    written = lambda alias: "(?ai)" + alias.replace("_", "[_ ]")
    for pdf in batches:
        rows = []
        for paper, page, text, keys in zip(pdf["paper_id"], pdf["page_no"], pdf["t"], pdf["keys"], strict=True):
            found, wanted, ends = set(), set(keys), [m.end() for m in said.finditer(text)]
            if not ends:
                continue
            for start, _, i in index.hits(text):
                key = index.entries[i][0]
                if key in wanted and key not in found and index.pattern(i, "written", written).match(text, start):
                    before = bisect_right(ends, start)
                    if before and start - ends[before - 1] <= NEGATED and not set(".。") & set(text[ends[before - 1] : start]):
                        found.add(key)
            rows += [(paper, key, page) for key in sorted(found)]
        yield pd.DataFrame(rows, columns=["paper_id", "key", "page_no"]).astype({"page_no": "int32"})


def negation_hints(pages: DataFrame, gaps: DataFrame) -> DataFrame:
    """Places where a missing parameter is said not to be used: hints, never values."""
    keys = gaps.groupBy("paper_id").agg(F.collect_set("key").alias("keys"))
    text = pages.select("paper_id", "page_no", V.collapse_space(F.coalesce("text", F.lit(""))).alias("t"))
    return text.join(keys.hint("merge"), "paper_id").mapInPandas(_negated, "paper_id string, key string, page_no int")


def gate(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ok and why. ``candidates``: paper_id, key, value, evidence (and page_no if known). The order of the checks is part
    of the result. Evidence is looked up in the pages of its own paper only."""
    norm = lambda c: V.collapse_space(F.coalesce(c, F.lit("")))
    rows = candidates.withColumn("_id", F.xxhash64("paper_id", "key", "value", "evidence")).withColumn("_e", norm(F.col("evidence")))
    text = pages.select("paper_id", norm(F.col("text")).alias("_t"))
    grounded = rows.select("paper_id", "_id", "_e").distinct().join(text.hint("merge"), "paper_id").filter((F.col("_e") != "") & F.contains("_t", "_e"))
    grounded = grounded.groupBy("paper_id", "_id").agg(F.min("_t").alias("_t"))
    rows = rows.join(grounded.hint("merge"), ["paper_id", "_id"], "left")
    at = F.expr("locate(value, _e)")
    before = F.expr("substring(_e, 1, greatest(locate(value, _e) - 1, 0))")
    after = F.expr("substring(_e, locate(value, _e) + length(value), 60)")
    rows = rows.withColumn("_at", at).withColumn("_b", before).withColumn("_a", after)
    # evidence may be cut out of a flattened table: its value is looked at once more where the page has it
    place = F.expr("locate(_e, _t) + _at - 1")
    rows = rows.withColumn("_pb", F.expr("substring(_t, greatest(locate(_e, _t) + _at - 41, 1), least(40, locate(_e, _t) + _at - 2))")).withColumn("_pa", F.substring("_t", place + F.length("value"), F.lit(40)))
    text_key = F.col("key").isin(*TEXT_VALUED)
    beside = lambda b, a: F.col(b).rlike(P.TABLE_NUM + r"\s+$") | F.col(a).rlike(r"^\s+" + P.TABLE_NUM + r"(?![A-Za-z])")
    run = (F.col("_at") > 0) & (beside("_b", "_a") | F.coalesce(beside("_pb", "_pa"), F.lit(False)))
    trap, shape = F.lit(False), F.lit(False)
    for key, pattern in P.SEMANTIC_TRAP.items():
        trap = trap | ((F.col("key") == key) & F.col("_e").rlike(pattern))
    for key, pattern in P.SHAPE.items():
        shape = shape | ((F.col("key") == key) & ~F.col("_e").rlike(pattern))
    why = V.first_reason([
        ("not_grounded", F.col("_t").isNull()),
        ("flattened_table", ~text_key & run),
        ("citation", (F.col("_at") > 0) & F.col("_b").rlike(r"[\[(（【]$") & F.col("_a").rlike(r"^[\])）】]")),
        ("semantic_trap", trap),
        ("no_letter", text_key & ~F.col("value").rlike("[A-Za-z一-鿿]")),
        ("distribution_call", ~text_key & inside_distribution(F.col("_b"))),
        ("range", ~text_key & (F.regexp_replace("value", "[eE][-+]", "e").rlike(r"\d\s*[-–—~]\s*\d") | F.col("_a").rlike(r"^\s*[-–—~]\s*\d"))),
        ("not_numeric", ~text_key & V.normalize_number(F.col("value")).isNull()),
        ("not_shown", ~snippet_contains(F.col("_e"), F.col("value"))),
        ("implausible", V.within_range(F.col("key"), V.normalize_number(F.col("value")), RANGES) == False),  # noqa: E712
        ("shape", shape),
    ])
    out = rows.withColumn("why", F.coalesce(why, F.lit("")))
    return out.withColumn("ok", F.col("why") == "").drop("_id", "_e", "_t", "_at", "_b", "_a", "_pb", "_pa")


def ladder(gaps: DataFrame, rungs: list[DataFrame], pages: DataFrame) -> DataFrame:
    """The first accepted candidate of the first rung that has one, for each missing parameter. Every rung
    (paper_id, page_no, key, value, evidence) sees only what the rungs before it left open."""
    fills = None
    for level, rung in enumerate(rungs, 1):
        open_ = gaps if fills is None else gaps.join(fills.select("paper_id", "key"), ["paper_id", "key"], "left_anti")
        ok = gate(rung.join(open_.select("paper_id", "key"), ["paper_id", "key"], "left_semi"), pages).filter("ok")
        w = Window.partitionBy("paper_id", "key").orderBy("page_no", "evidence", "value")
        got = ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("paper_id", "key", "value", V.normalize_number(F.col("value")).alias("num"), "page_no", "evidence", F.lit(level).alias("rung"))
        fills = got if fills is None else fills.unionByName(got)
    return fills


def fill_missing(pages: DataFrame, mentioned: DataFrame, evidence: DataFrame, proposals: DataFrame | None = None) -> dict[str, DataFrame]:
    """fills, hints and what stays missing; ``proposals`` are candidates of an outside model, the last rung."""
    gaps = missing(mentioned, evidence)
    scanned = scan_candidates(pages, gaps)
    columns = ["paper_id", "page_no", "key", "value", "evidence"]
    rungs = [scanned.filter("level = 1").select(columns), scanned.filter("level = 2").select(columns)]
    if proposals is not None:
        rungs.append(proposals.select(columns))
    fills = ladder(gaps, rungs, pages)
    return {"fills": fills, "hints": negation_hints(pages, gaps), "unfilled": gaps.join(fills.select("paper_id", "key"), ["paper_id", "key"], "left_anti")}


def rescue_json(text: Column) -> Column:
    """The JSON object inside a model's answer, from its first to its last brace; null if it is none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.try_parse_json(body))
