"""Evidence in code: a syntax-tree table function for Python, expressions for every other language, JSON and YAML walks."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import OPTIMIZER_CLASSES, RANGES, SCHEDULER_CLASSES, SEED_CALLS, TEXT_VALUED
from ..functions import values as V
from ..sources.code import notebook_cells
from .lexical import code_of_lines

#: What the table function gives for each place; key rules and types are applied to it as expressions.
SITE = "code_id string, file string, cell int, seq int, name string, form string, raw string, kind string, line int, snippet string"
_SITE_NAMES = [c.split()[0] for c in SITE.split(", ")]


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _constant(node: ast.AST) -> tuple[str, str] | None:
    """(text, kind) of a literal: number, text or flag."""
    sign = ""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        sign, node = "-", node.operand
    if not isinstance(node, ast.Constant) or node.value is None:
        return None
    v = node.value
    if isinstance(v, bool):
        return str(v), "flag"
    if isinstance(v, (int, float)):
        return sign + str(v), "number"
    return (v, "text") if isinstance(v, str) and not sign else None


def _target(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def sites(source: str) -> Iterator[tuple[str, str, str | None, str, int, int]]:
    """(name, form, raw, kind, line, end line) of every place that may set a parameter, in the order of the text.

    Forms: assign, keyword, default, compare, optimizer, scheduler, seed. kind "name" is a reference.
    """
    for node in ast.walk(ast.parse(source)):
        line, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            value = _constant(node.value)
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                name = _target(t)
                if value and name:
                    yield name, "assign", *value, line, end
        elif isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], (ast.Gt, ast.GtE, ast.Lt, ast.LtE, ast.Eq, ast.NotEq)):
            sides = [(node.left, node.comparators[0]), (node.comparators[0], node.left)]
            for named, other in sides:
                value = _constant(other) if isinstance(other, ast.Constant) else None
                if value and value[1] == "number" and _target(named):
                    yield _target(named), "compare", *value, line, end
                    break
        elif isinstance(node, ast.Call):
            chain = _dotted(node.func)
            last = chain.rpartition(".")[2]
            if chain in SEED_CALLS and node.args:
                value = _constant(node.args[0])
                name = node.args[0].id if isinstance(node.args[0], ast.Name) else ""
                yield "seed", "seed", *(value or (name, "name")), line, end
            if last in OPTIMIZER_CLASSES:
                yield "optimizer", "optimizer", last, "text", line, end
            elif last in SCHEDULER_CLASSES:
                yield "scheduler", "scheduler", last, "text", line, end
            for k in node.keywords:
                value = _constant(k.value)
                if k.arg and (value or isinstance(k.value, ast.Name)):
                    yield k.arg, "keyword", *(value or (k.value.id, "name")), line, end
            if last == "add_argument" and node.args and (flag := _constant(node.args[0])) and flag[1] == "text":
                for k in node.keywords:
                    if k.arg == "default" and (value := _constant(k.value)):
                        yield flag[0].lstrip("-"), "default", *value, line, end


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sites of each source; one that does not parse gives a row of kind "error"."""
    for pdf in batches:
        rows = []
        for code_id, file, cell, text in zip(pdf["code_id"], pdf["file"], pdf["cell"], pdf["text"], strict=True):
            lines = text.splitlines()
            try:
                found = sorted(sites(text), key=lambda s: s[4])
            except (SyntaxError, ValueError, RecursionError) as e:
                rows.append((code_id, file, cell, 0, "", "error", f"{type(e).__name__}: {e}"[:200], "error", len(lines), ""))
                continue
            for seq, (name, form, raw, kind, line, end) in enumerate(found):
                snippet = " ".join(x.strip() for x in lines[line - 1 : end] if x.strip())[:240]
                rows.append((code_id, file, cell, seq, name, form, raw, kind, line, snippet))
        yield pd.DataFrame(rows, columns=_SITE_NAMES).astype({"cell": "int32", "seq": "int32", "line": "int32"})


def python_sites(files: DataFrame) -> DataFrame:
    scripts = files.filter("kind = 'py'").select("code_id", F.col("path").alias("file"), F.lit(-1).alias("cell"), "text")
    cells = notebook_cells(files).select("code_id", F.col("path").alias("file"), F.col("cell").cast("int").alias("cell"), "text")
    return scripts.unionByName(cells).mapInPandas(_parse, SITE)


def failed_files(python: DataFrame) -> DataFrame:
    return python.filter("kind = 'error'").select("code_id", "file", F.col("raw").alias("reason"), F.col("line").alias("lines"))


def _place(file: Column, cell: Column, line: Column) -> Column:
    return F.when(cell >= 0, F.concat(file, F.lit("[cell"), cell, F.lit("]:L"), line)).otherwise(F.concat(file, F.lit(":"), line))


def _evidence(df: DataFrame, channel: str) -> DataFrame:
    """Common columns of code evidence from rows with key, raw, dynamic, form, place."""
    num = F.when(~F.col("dynamic"), V.normalize_number(F.col("raw")))
    named = F.coalesce(*[F.when((F.col("form") == form) & (F.col("raw") == cls), label) for form, table in (("optimizer", OPTIMIZER_CLASSES), ("scheduler", SCHEDULER_CLASSES)) for cls, label in table.items()])
    txt = F.when(~F.col("dynamic") & num.isNull(), F.coalesce(named, F.lower(F.regexp_replace("raw", r"\s+", ""))))
    raw = F.when(F.col("dynamic"), F.concat(F.lit("变量 "), "raw", F.lit("(运行时确定)"))).otherwise(F.col("raw"))
    return df.select(
        F.col("code_id").alias("owner_id"), F.lit("code").alias("side"), "key", "ordinal", raw.alias("raw_value"), num.alias("num"), txt.alias("txt"),
        "location", "file", F.lit(None).cast("int").alias("page"), "line", "snippet", F.lit(channel).alias("channel"), F.lit(False).alias("excluded"), "form",
    )


def python_evidence(python: DataFrame) -> DataFrame:
    """Typed evidence with a reason where it is rejected (null: accepted)."""
    name = F.regexp_replace("name", "-", "_")
    key = F.when(F.col("form").isin("optimizer", "scheduler", "seed"), F.col("name")).otherwise(V.canonical_key(name))
    scored = (F.col("form") == "compare") & key.isNull() & F.col("name").rlike("(?i)(score|thresh|cutoff|limit)")
    valued = python.filter("kind <> 'error'").withColumn("key", F.when(scored, "threshold").otherwise(key)).withColumn("inline", scored)
    rows = valued.withColumn("form", F.when(F.col("inline"), "score").otherwise(F.col("form"))).filter("key is not null")
    rows = rows.filter((F.length("name") > 1) | ~F.col("name").rlike("^[\\x00-\\x7F]$")).withColumn("dynamic", F.col("kind") == "name")
    text_key = F.col("key").isin(*TEXT_VALUED)
    typed = F.col("dynamic") | F.when(text_key, (F.col("kind") == "text") & (F.trim("raw") != "")).otherwise((F.col("kind") != "flag") & V.normalize_number(F.col("raw")).isNotNull())
    ordinal = F.xxhash64("file").bitwiseAND(0x3FFFFFFF) * (1 << 32) + F.greatest(F.col("cell"), F.lit(0)) * (1 << 20) + F.col("seq")
    placed = rows.filter(typed).withColumn("location", _place(F.col("file"), F.col("cell"), F.col("line"))).withColumn("ordinal", ordinal)
    out = _evidence(placed, "ast")
    return out.withColumn("reason", F.when((F.col("form") != "score") & (V.within_range(F.col("key"), F.col("num"), RANGES) == False), "超出领域先验范围, 疑似错位抽取"))  # noqa: E712


_ASSIGN = r"^\s*(?:[-*]\s+)?([A-Za-z_][A-Za-z0-9_.]{1,40})\s*(?:=|<-|:=|:\s)\s*('[^']*'|\"[^\"]*\"|[-+]?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+|true|false|True|False)\s*(?:[,;\)\]]|$)"
_FLAG = r"--([A-Za-z_][A-Za-z0-9_\-]{1,30})(?:\s*=\s*|\s+)('[^']*'|\"[^\"]*\"|[-+]?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+|[A-Za-z_][A-Za-z0-9_\-.]{0,30})"


def multilang_evidence(files: DataFrame) -> DataFrame:
    """Assignments and command-line flags in files of other languages, line by line, comments aside."""
    lines = files.filter("kind = 'lang'").select("code_id", F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    code = code_of_lines(lines, ["code_id", "file"]).withColumnsRenamed({"line_no": "_p", "line": "raw_line"}).filter(F.col("code").rlike("=|<-|:|--"))
    assign = F.when(F.col("code").rlike(_ASSIGN), F.array(F.struct(F.regexp_extract("code", _ASSIGN, 1).alias("name"), F.regexp_extract("code", _ASSIGN, 2).alias("rhs"))))
    pair = lambda n, r: F.struct(n.alias("name"), r.alias("rhs"))
    flags = F.zip_with(F.regexp_extract_all("code", F.lit(_FLAG), F.lit(1)), F.regexp_extract_all("code", F.lit(_FLAG), F.lit(2)), pair)
    rows = code.select("code_id", "file", (F.col("_p") + 1).alias("line"), "raw_line", F.posexplode(F.concat(F.coalesce(assign, F.array().cast("array<struct<name:string,rhs:string>>")), flags)).alias("seq", "m"))
    last = F.regexp_extract("m.name", r"([^.]+)$", 1)
    raw = F.regexp_replace("m.rhs", "^(['\"])(.*)\\1$", "$2")
    rows = rows.select("code_id", "file", "line", "seq", F.substring(F.trim("raw_line"), 1, 200).alias("snippet"), F.coalesce(V.canonical_key(last), V.canonical_key(F.col("m.name"))).alias("key"), raw.alias("raw"))
    text_key = F.col("key").isin(*TEXT_VALUED)
    good = F.when(text_key, F.col("raw").rlike(r"^[A-Za-z_][\w \-.]{1,40}$")).otherwise(~F.lower("raw").isin("true", "false") & V.normalize_number(F.col("raw")).isNotNull() & F.coalesce(V.is_plausible(F.col("key"), F.col("raw")), F.lit(True)))
    rows = rows.filter(F.col("key").isNotNull() & (F.trim("raw") != "") & good)
    ordinal = F.xxhash64("file").bitwiseAND(0x3FFFFFFF) * (1 << 32) + F.col("line") * 64 + F.col("seq")
    placed = rows.withColumn("location", F.concat("file", F.lit(":"), "line")).withColumn("ordinal", ordinal).withColumn("dynamic", F.lit(False)).withColumn("form", F.lit("line"))
    return _evidence(placed, "regex").withColumn("reason", F.lit(None).cast("string"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves of nested mappings; lists are not entered, a text that cannot be read gives none."""
    for pdf in batches:
        rows = []
        for code_id, file, text in zip(pdf["code_id"], pdf["file"], pdf["text"], strict=True):
            try:
                if file.lower().endswith(".json"):
                    data = json.loads(text)
                else:
                    import yaml

                    data = yaml.safe_load(text)
            except Exception:  # noqa: BLE001  whatever a reader raises on foreign text, the file has no settings then
                continue
            todo = [("", data)] if isinstance(data, dict) else []
            while todo:
                prefix, node = todo.pop(0)
                for k, v in node.items():
                    if isinstance(v, dict):
                        todo.append((f"{prefix}{k}.", v))
                    elif isinstance(v, (int, float, str)):
                        rows.append((code_id, file, len(rows), str(k), str(v), f"{prefix}{k}: {v}"))
        yield pd.DataFrame(rows, columns=["code_id", "file", "seq", "name", "raw", "snippet"]).astype({"seq": "int32"})


def config_evidence(files: DataFrame) -> DataFrame:
    configs = files.filter("kind = 'config'").select("code_id", F.col("path").alias("file"), "text")
    rows = configs.mapInPandas(_walk, "code_id string, file string, seq int, name string, raw string, snippet string")
    rows = rows.withColumn("key", V.canonical_key(F.col("name"))).filter("key is not null")
    ordinal = F.xxhash64("file").bitwiseAND(0x3FFFFFFF) * (1 << 32) + F.col("seq")
    placed = rows.withColumn("location", F.concat("file", F.lit("(config)"))).withColumn("line", F.lit(None).cast("int")).withColumn("ordinal", ordinal).withColumn("dynamic", F.lit(False)).withColumn("form", F.lit("config"))
    return _evidence(placed, "config").withColumn("reason", F.lit(None).cast("string"))


def code_evidence(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All evidence of code with its reason of rejection, and the files that do not parse."""
    python = python_sites(files)
    every = python_evidence(python).unionByName(config_evidence(files)).unionByName(multilang_evidence(files))
    return every, failed_files(python)


def aux_only_keys(evidence: DataFrame) -> DataFrame:
    """Keys whose evidence is all in tests, examples or notebooks."""
    aux = V.is_aux(F.col("location")) | F.contains(F.col("location"), F.lit("[cell"))
    return evidence.groupBy("owner_id", "key").agg(F.bool_and(aux).alias("aux_only")).filter("aux_only").drop("aux_only")


def language_counts(evidence: DataFrame) -> DataFrame:
    return evidence.filter("channel = 'regex'").groupBy("owner_id", "file", V.language_of(F.col("file")).alias("language")).agg(F.count("*").alias("n"))
