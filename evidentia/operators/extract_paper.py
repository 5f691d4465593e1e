"""Claims in paper pages: offsets come from one table function, every guard is an expression on its slices."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import patterns as P
from ..dims import PARAMS, RANGES, TEXT_VALUED
from ..functions import values as V
from ..functions.names import NameIndex, bounded, is_word, spaced

HIT = "paper_id string, page_no int, gen int, seq int, key string, raw string, line_no int, start int, before string, after string, tail string, context string, line string, section string, snippet string"
_HIT_NAMES = [c.split()[0] for c in HIT.split(", ")]
FORWARD, REVERSE, GAP, TEXT, DATASET, RESULT = range(1, 7)

_CJK = re.compile("[一-鿿]")


def _forward(alias: str) -> str:
    if _CJK.search(alias):
        return rf"{spaced(alias)}\s*(?:[A-Za-zσ]{{1,3}}[₀-₉]?\s*)?{P.CONNECTORS}?\s*{P.NUM_B}"
    return rf"(?i)\b{spaced(alias)}\b\s*{P.CONNECTORS}?\s*{P.NUM_B}"


def _ignoring_case(make):
    return lambda alias: "(?i)" + make(alias)


class _Finder:
    """The names and patterns of one worker. Names are found by one automaton; a number's context is looked at around its hits only."""

    def __init__(self, params: Mapping[str, tuple[str, Sequence[str]]] = PARAMS) -> None:
        self.index = NameIndex(params)
        keys = [k for k, _ in self.index.entries]
        self.numeric = {i for i, k in enumerate(keys) if k not in ("optimizer", "scheduler", "model")}
        self.valued = {i for i, k in enumerate(keys) if k not in TEXT_VALUED}
        self.special = {i for i, (_, a) in enumerate(self.index.entries) if len(a) >= 6 or " " in a or "_" in a}
        fixed = [(REVERSE, k, p) for k, ps in P.REVERSE.items() for p in ps]
        fixed += [(TEXT, k, p) for k, ps in P.TEXT_PATTERNS.items() for p in ps]
        fixed += [(RESULT, k, p) for k, p in P.RESULTS]
        self.direct = [(g, k, re.compile(p)) for g, k, p in fixed]
        self.dataset = re.compile(P.DATASET)
        self.sentence = re.compile(P.SENTENCE)
        self.number, self.word = re.compile(P.NUM_B), re.compile(r"(?i)\b(zero|none)\b")
        self.connector, self.bad_gap = re.compile(P.GAP_CONNECTOR), re.compile(P.GAP_VETO)

    def forward(self, text: str, places: dict[int, list[int]]) -> Iterator[tuple[int, str, str, int, int]]:
        """Numbers right behind a name."""
        for i, starts in places.items():
            if i not in self.numeric:
                continue
            pattern, done = self.index.pattern(i, "forward", _forward), 0
            for start in starts:
                if start >= done and (m := pattern.match(text, start)):
                    yield FORWARD, self.index.entries[i][0], m[m.lastindex].strip(), m.start(), m.end()
                    done = m.end()

    def names_other(self, text: str, places: dict[int, list[int]], start: int, end: int) -> bool:
        """Whether a name stands, as a word of its own, between two places of a text."""
        for i, starts in places.items():
            if i in self.special:
                for at in starts[bisect_left(starts, start) :]:
                    if at >= end:
                        break
                    m = self.index.pattern(i, "spaced", _ignoring_case(spaced)).match(text, at, end)
                    if m and (at == start or not is_word(text[at - 1])) and (m.end() == end or not is_word(text[m.end()])):
                        return True
        return False

    def gaps(self, text: str, places: dict[int, list[int]]) -> Iterator[tuple[str, str, int, int]]:
        """For each parameter the first value that a connector ties to its name from further off in a sentence."""
        done: set[str] = set()
        named = sorted((start, i) for i, starts in places.items() if i in self.valued for start in starts)
        begins = [start for start, _ in named]
        for sentence in self.sentence.finditer(text):
            body, offset = sentence[0], sentence.start()
            inside: dict[int, list[int]] = {}
            for start, i in named[bisect_left(begins, offset) : bisect_left(begins, sentence.end())]:
                inside.setdefault(i, []).append(start - offset)
            for i in sorted(inside):
                key = self.index.entries[i][0]
                if key in done:
                    continue
                pattern = self.index.pattern(i, "bounded", _ignoring_case(bounded))
                hit = next((m for at in inside[i] if (m := pattern.match(body, at))), None)
                if hit is None:
                    continue
                tail = body[hit.end() : hit.end() + P.GAP_LIMIT]
                for found, value in ((self.number.search(tail), None), (self.word.search(tail), "0")):
                    if found is None:
                        continue
                    gap = tail[: found.start()]
                    first = offset + hit.end()
                    if self.connector.search(gap) and not self.bad_gap.search(gap) and not self.names_other(text, places, first, first + found.start()):
                        done.add(key)
                        yield key, value or found[1], offset, first + found.end()
                        break

    def hits(self, text: str) -> Iterator[tuple[int, str, str, int, int]]:
        places = self.index.places(text)
        yield from self.forward(text, places)
        for gen, key, pattern in self.direct:
            for m in pattern.finditer(text):
                yield gen, key, (m[m.lastindex] if m.lastindex else m[0]).strip(), m.start(), m.end()
        for key, raw, start, end in self.gaps(text, places):
            yield GAP, key, raw, start, end
        for m in self.dataset.finditer(text):
            yield DATASET, "dataset", m[1] + (f" v{m[2]}" if m[2] else ""), m.start(), m.end()


_FINDERS: list[_Finder] = []


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every match of a page with the slices that the guards look at."""
    if not _FINDERS:
        _FINDERS.append(_Finder())
    finder, heading = _FINDERS[0], re.compile(P.HEADING)
    for pdf in batches:
        rows = []
        for paper, page, text, following in zip(pdf["paper_id"], pdf["page_no"], pdf["text"], pdf["next_text"], strict=True):
            guard = f"{text}\n{following}"
            lines = guard.split("\n")
            own = text.count("\n") + 1
            titles, section = [], ""
            for x in lines[:own]:
                s = x.strip()
                if 3 <= len(s) <= 45 and heading.match(s) and not s.endswith("."):
                    section = s
                titles.append(section)
            for seq, (gen, key, raw, start, end) in enumerate(finder.hits(text)):
                first, last = guard.count("\n", 0, start), guard.count("\n", 0, end)
                rows.append((
                    paper, page, gen, seq, key, raw, first + 1, start, text[max(0, start - 90) : start], text[start:end] + text[end : end + 90], guard[end : end + 40],
                    "\n".join(lines[max(0, first - (2 if first and guard[start - 1 : start] == "\n" else 1)) : last + 3]), lines[first], titles[first], " ".join(text[max(0, start - 80) : end + 80].split()),
                ))
        yield pd.DataFrame(rows, columns=_HIT_NAMES).astype({"page_no": "int32", "gen": "int32", "seq": "int32", "line_no": "int32", "start": "int32"})


def find_matches(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy("page_no")
    seen = pages.select("paper_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    ahead = seen.withColumn("next_text", F.coalesce(F.lead("text").over(w), F.lit("")))
    return ahead.mapInPandas(_find, HIT)


def _any(table: dict[str, list[tuple[str, str]]], context: Column) -> list[tuple[str, Column]]:
    return [(why, (F.col("key") == key) & context.rlike(pattern)) for key, rules in table.items() for pattern, why in rules]


def in_bibliography() -> Column:
    return F.col("context").rlike(P.BIBLIOGRAPHY) | F.col("line").rlike(P.BIB_ENTRY)


def numeric_guards() -> list[tuple[str, Column]]:
    """What refuses a numeric match, in the order that is part of the result."""
    around = F.concat("before", "after")
    value_end = F.col("tail")
    bracketed = F.col("before").rlike(r"[\[(（【]$") & value_end.rlike(r"^[\])）】]")
    factor = (F.col("key") != "input_size") & (F.substring(F.col("before"), -8, 8).rlike(r"[×xX*]\s*$") | F.substring(value_end, 1, 8).rlike(r"^\s*[×xX*]"))
    run = F.substring(F.col("before"), -40, 40).rlike(P.TABLE_NUM + r"\s*$") | value_end.rlike(r"^\s*" + P.TABLE_NUM)
    return [
        ("命中处位于参考文献条目, 疑似引用内容而非论文设置", in_bibliography()),
        *_any(P.CONTEXT_VETO, around),
        ("取值是纯数字, 不是数据集名, 已丢弃", (F.col("key") == "dataset") & F.col("raw").rlike(r"^[\d.,%]+$")),
        ("取值被方括号包着, 是参考文献/图表编号, 已丢弃", bracketed),
        ("取值处在乘法公式里(两侧有 ×), 不是独立设置值, 已丢弃", factor),
        ("位于表格的多列取值中（表头后跟一串裸数字），无法确定哪一列对应本实验配置，已丢弃", run),
        ("超出领域先验范围, 疑似错位抽取", V.within_range(F.col("key"), V.normalize_number(F.col("raw")), RANGES) == False),  # noqa: E712
    ]


def numeric_reason() -> Column:
    """The first guard that a numeric match fails."""
    return V.first_reason(numeric_guards())


def text_guards() -> list[tuple[str, Column]]:
    """What refuses a name that a text pattern found, in order."""
    around, low = F.concat("before", "after"), F.lower("raw")
    homonym = F.lit(False)
    for key, pattern in P.TEXT_VETO.items():
        homonym = homonym | ((F.col("key") == key) & around.rlike(pattern))
    model = F.col("key") == "model"
    inflected = (F.col("raw") == low) & low.rlike("(?:ing|ed|ly)$") & ~low.isin(*P.MODEL_NAMES)
    return [
        ("命中处位于参考文献条目, 疑似引用内容", in_bibliography()),
        ("语境里出现无关的表述(同形词), 已丢弃", homonym),
        ("取值以连字符结尾, 是 PDF 断行残片, 已丢弃", F.col("raw").rlike("[-–—]$")),
        ("取值是普通虚词/动词, 不是架构名, 已丢弃", model & low.isin(*P.MODEL_STOPWORDS)),
        ("取值是动词/副词形态, 不是架构名, 已丢弃", model & inflected),
    ]


def text_reason() -> Column:
    return V.first_reason(text_guards())


def _location() -> Column:
    return F.concat(F.lit("Page "), "page_no", F.when(F.col("section") != "", F.concat(F.lit(" · "), "section")).otherwise(""))


def _claims(df: DataFrame, txt: Column, num: Column, channel: str = "text") -> DataFrame:
    return df.select(
        F.col("paper_id").alias("owner_id"), F.lit("paper").alias("side"), "key", "ordinal", F.col("raw").alias("raw_value"), num.alias("num"), txt.alias("txt"), "location",
        F.lit(None).cast("string").alias("file"), F.col("page_no").alias("page"), F.col("line_no").alias("line"), "snippet", F.lit(channel).alias("channel"), "excluded",
    )


def _ordinal() -> Column:
    return F.col("page_no").cast("long") * 100_000_000 + F.col("gen") * 10_000_000 + F.col("seq")


def _first_pages(df: DataFrame) -> DataFrame:
    return df.groupBy("paper_id", "key").agg(F.min("page_no").alias("first_page"))


def paper_evidence(pages: DataFrame, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """evidence (all accepted claims in order), rejected, and results of papers; ``hits``, the matches behind them, is persisted for their use."""
    # every branch below reads the matches: a page is searched once, and what is found stays on disk until ``hits`` is unpersisted
    found = find_matches(pages).persist(StorageLevel.DISK_ONLY)
    hits = found.withColumn("location", _location()).withColumn("ordinal", _ordinal()).withColumn("excluded", F.col("snippet").rlike(P.EXCLUDED_CONTEXT))
    none = F.lit(None)
    numeric = hits.filter(F.col("gen").isin(FORWARD, REVERSE, GAP)).withColumn("reason", numeric_reason())
    good = numeric.filter("reason is null")
    direct = good.filter(F.col("gen") != GAP)
    tables = table_claims(cells) if cells is not None else None
    # a value from further off counts only while no page up to its own has given one
    known = _first_pages(direct.select("paper_id", "key", "page_no"))
    if tables is not None:
        known = _first_pages(direct.select("paper_id", "key", "page_no").unionByName(tables.select(F.col("owner_id").alias("paper_id"), "key", (F.col("page") + 1).alias("page_no"))))
    gaps = good.filter(F.col("gen") == GAP).join(known, ["paper_id", "key"], "left").filter("first_page is null or first_page > page_no")
    once = Window.partitionBy("paper_id", "key").orderBy("page_no", "seq")
    gaps = gaps.withColumn("_r", F.row_number().over(once)).filter("_r = 1").select(direct.columns)
    numbers = _claims(direct.unionByName(gaps), none.cast("string"), V.normalize_number(F.col("raw")))
    texts = hits.filter(F.col("gen") == TEXT).withColumn("reason", text_reason())
    generic = F.lower("raw").isin(*P.GENERIC_MODELS).cast("int")
    best = Window.partitionBy("paper_id", "key").orderBy("page_no", generic, "seq")
    named = texts.filter("reason is null").withColumn("_r", F.row_number().over(best)).filter("_r = 1").withColumn("excluded", F.lit(False))
    datasets = hits.filter((F.col("gen") == DATASET) & ~in_bibliography() & F.col("line").rlike(P.DATASET_CONTEXT))
    name = F.regexp_replace("raw", r" v[\d.]+$", "")
    whole = pages.join(datasets.select("paper_id", name.alias("name")).distinct(), "paper_id").groupBy("paper_id", "name").agg(F.sum(V.occurrences(F.coalesce("text", F.lit("")), F.col("name"))).alias("times"))
    trained = F.when(F.col("line").rlike(P.DATASET_TRAIN), 0).otherwise(1)
    chosen = Window.partitionBy("paper_id").orderBy("trained", F.desc("times"), "location", "ordinal")
    ranked = datasets.withColumn("name", name).withColumn("trained", trained).join(whole, ["paper_id", "name"]).withColumn("_r", F.row_number().over(chosen))
    dataset = ranked.filter("_r = 1").withColumn("excluded", F.lit(False))
    if tables is not None:
        in_table = tables.filter("key = 'dataset'").select(F.col("owner_id").alias("paper_id")).distinct()
        dataset = dataset.join(in_table, "paper_id", "left_anti")
    lowered = F.lower(F.regexp_replace(F.trim("raw"), r"\s+", " "))
    words = _claims(named, lowered, none.cast("double")).unionByName(_claims(dataset, F.lower(F.regexp_replace("raw", r"\s+", "")), none.cast("double")))
    evidence = numbers.unionByName(words)
    if tables is not None:
        evidence = evidence.unionByName(tables)
    # the same value at the same place counts once
    value = F.coalesce(F.col("num").cast("string"), "txt")
    evidence = _first_by_place(evidence.withColumn("_v", value))
    metric = Window.partitionBy("paper_id", "key").orderBy("page_no", "seq")
    results = hits.filter((F.col("gen") == RESULT)).withColumn("_r", F.row_number().over(metric)).filter((F.col("_r") == 1) & ~in_bibliography())
    rejected = numeric.filter("reason is not null").unionByName(texts.filter("reason is not null"))
    return {
        "hits": found,
        "evidence": evidence,
        "rejected": rejected.select(F.col("paper_id").alias("owner_id"), F.lit("paper").alias("side"), "key", F.col("raw").alias("value"), "location", "reason"),
        "results": _claims(results, none.cast("string"), V.normalize_number(F.col("raw"))),
    }


def _first_by_place(evidence: DataFrame) -> DataFrame:
    w = Window.partitionBy("owner_id", "key", "location", "_v").orderBy("ordinal")
    return evidence.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_v")


def table_claims(cells: DataFrame) -> DataFrame:
    """Claims of parameter tables: a name cell with the nearest value to its right, else from the row's start."""
    rows = cells.select("paper_id", "page_no", "table_no", "row_no", "col_no", F.trim(F.coalesce("cell", F.lit(""))).alias("cell"))
    row = Window.partitionBy("paper_id", "page_no", "table_no", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = rows.withColumn("cells", F.collect_list("cell").over(row)).withColumn("at", F.row_number().over(Window.partitionBy("paper_id", "page_no", "table_no", "row_no").orderBy("col_no")))
    header = whole.filter("at = 1").groupBy("paper_id", "page_no", "table_no").agg(F.min_by(F.array_join("cells", " "), "row_no").alias("header"))
    key = F.coalesce(V.canonical_key(F.col("cell")), V.canonical_key(F.replace(F.col("cell"), F.lit(" "), F.lit("_"))))
    named = whole.filter((F.length("cell") <= 30) & F.col("cell").rlike(P.TABLE_NAME_CELL)).withColumn("key", key).filter("key is not null")
    named = named.join(header.filter(F.substring("header", 1, 300).rlike(P.TABLE_HEADER)), ["paper_id", "page_no", "table_no"])
    ring = F.concat(F.slice("cells", F.col("at") + 1, F.size("cells")), F.slice("cells", F.lit(1), F.col("at") - 1))
    word = F.col("key").isin(*TEXT_VALUED)
    fits = F.filter(ring, lambda c: (c != "") & (F.length(c) <= 40) & F.when(word, c.rlike(r"^[A-Za-z_][\w \-.]{1,40}$")).otherwise(V.normalize_number(c).isNotNull()))
    found = named.withColumn("raw", F.get(fits, F.lit(0))).filter("raw is not null")
    numbers = F.size(F.filter("cells", lambda c: F.coalesce(V.normalize_number(c) != 0, F.lit(False))))
    out = found.withColumn("location", F.concat(F.lit("Page "), "page_no", F.lit(" · 表格"), "table_no")).withColumn("excluded", F.substring("header", 1, 200).rlike(P.SWEEP_TABLE) | (numbers > 2))
    out = out.withColumn("snippet", F.substring(F.array_join("cells", " | "), 1, 200)).withColumn("line_no", F.col("row_no")).withColumn("ordinal", F.col("page_no").cast("long") * 100_000_000 + 90_000_000 + F.col("table_no") * 100_000 + F.col("row_no") * 100 + F.col("col_no"))
    num = V.normalize_number(F.col("raw"))
    return _claims(out, F.when(num.isNull(), F.lower(F.regexp_replace("raw", r"\s+", ""))), num, "table")


def alias_pattern(key: str) -> str:
    """A pattern of all names of a parameter, in any case."""
    names = PARAMS[key][1]
    plain, others = [a.lower() for a in names if not _CJK.search(a)], [re.escape(a) for a in names if _CJK.search(a)]
    return "(?i)" + "|".join([r"(?<![A-Za-z0-9_])(?:" + "|".join(map(spaced, plain)) + r")(?![A-Za-z0-9_])", *others])


def _plain(alias: str) -> str:
    """A pattern of a lower-case name in lower-case text, whose separators are ASCII ones."""
    return re.escape(alias.lower()) if _CJK.search(alias) else r"(?<![a-z0-9_])" + re.escape(alias.lower()).replace(r"\ ", r"[ \t\n\x0b\f\r_\-]") + r"(?![a-z0-9_])"


def kinds_named(index: NameIndex, low: str) -> set[str]:
    """The parameters that a lower-case text names; homonyms do not count."""
    found: set[str] = set()

    def look(text: str, wanted) -> None:
        for start, _, i in index.hits(text):
            key = index.entries[i][0]
            if key not in found and wanted(key) and index.pattern(i, "plain", _plain).match(text, start):
                found.add(key)

    vetoed = {k: p for k, p in _vetoes().items() if p.search(low)}
    look(low, lambda key: key not in vetoed)
    for key, veto in vetoed.items():
        look(veto.sub(" ", low), key.__eq__)
    return found


_VETOES: dict[str, re.Pattern[str]] = {}


def _vetoes() -> dict[str, re.Pattern[str]]:
    if not _VETOES:
        _VETOES.update({k: re.compile(p) for k, p in P.ALIAS_VETO.items()})
    return _VETOES


def _mention(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _FINDERS:
        _FINDERS.append(_Finder())
    index = _FINDERS[0].index
    for pdf in batches:
        rows = [(paper, key) for paper, low in zip(pdf["paper_id"], pdf["t"], strict=True) for key in sorted(kinds_named(index, low))]
        yield pd.DataFrame(rows, columns=["paper_id", "key"])


def mentioned_kinds(pages: DataFrame) -> DataFrame:
    """(paper_id, key) of parameters that a page names, with or without a value; homonyms do not count."""
    low = pages.select("paper_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return low.mapInPandas(_mention, "paper_id string, key string").distinct()


def declarations(pages: DataFrame) -> DataFrame:
    """How many places of a paper look like a declaration of a value."""
    return pages.groupBy("paper_id").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(P.DECLARATION))).cast("long").alias("n"))


def title_and_abstract(pages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: (F.length(x) > 4) & ~x.rlike(r"^\d+$"))
    english = F.regexp_extract(text, r"(?is)\babstract\b[\s\-—:]*(.{50,1200}?)(?:\n\s*\n|\b1\.?\s*Introduction\b|\bI\.\s*INTRODUCTION\b)", 1)
    chinese = F.regexp_extract(text, r"(?s)摘要[\s:：]*(.{50,1500}?)(?:关键词|关键字)", 1)
    return pages.filter("page_no = 1").select("paper_id", F.get(lines, F.lit(0)).alias("title"), V.collapse_space(F.when(english != "", english).otherwise(chinese)).alias("abstract"))
