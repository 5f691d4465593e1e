"""Which assignment takes effect, and value-only patch drafts that refuse whatever is in doubt."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import PATCHABLE
from ..functions import values as V
from .align import value_text

MAX_ITEMS = 8
#: Lines of context on each side of a change.
AROUND = 3
# Parts of file names that tell shared, entry and configuration files.
BASE_HINTS, ENTRY_HINTS, CONFIG_HINTS = "base|common|default|util|abstract", "train|main|run|launch|finetune", "config|cfg|setting"


def site_class(file):
    stem = F.regexp_replace(F.lower(F.regexp_extract(file, r"([^/\\]+)$", 1)), r"\.py$", "")
    return F.when(stem.rlike(BASE_HINTS), "base").when(stem.rlike(ENTRY_HINTS), "entry").when(F.lower(file).rlike(CONFIG_HINTS), "config").otherwise("other")


def _placed(code: DataFrame) -> DataFrame:
    """Distinct assignment sites; evidence without a line is no site."""
    kind = site_class(F.col("file"))
    base = F.when(kind == "base", -1).when(kind == "entry", 4).when(kind == "config", 0).otherwise(1)
    return code.filter(F.col("line").isNotNull() & (F.col("form") != "seed")).select("audit_id", "key", "file", "line", F.col("raw_value").alias("value"), kind.alias("kind"), (base + (F.col("line") > 200).cast("int")).alias("score")).distinct()


def sites(code: DataFrame) -> DataFrame:
    """Distinct assignment sites of each key, ranked."""
    w = Window.partitionBy("audit_id", "key").orderBy(F.desc("score"), "file", "line", "value")
    return _placed(code).withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w))


def traces(findings: DataFrame, code: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """The effective assignment of each inconsistent key, at most ``most`` keys an audit; where it cannot be told, it says so."""
    wanted = findings.filter(F.col("status").isin("inconsistent", "internal_inconsistent") & ~F.col("key").startswith("result_"))
    keys = wanted.groupBy("audit_id", "key").agg(F.min("seq").alias("seq"))
    keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy("audit_id").orderBy("seq"))).filter(F.col("_r") <= most).drop("_r")
    listed = _placed(code).groupBy("audit_id", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "file", "line", "value", "kind", "score"))).alias("s"))
    ranked = F.transform("s", lambda x, i: F.struct((i + 1).alias("rank"), x["file"].alias("file"), x["line"].alias("line"), x["value"].alias("value"), x["kind"].alias("kind"), x["score"].alias("score")))
    first = lambda c: F.get("s", F.lit(0))[c].alias(c)
    listed = listed.select("audit_id", "key", ranked.alias("candidates"), first("file"), first("line"), first("value"), first("score"), F.get("s", F.lit(1))["score"].alias("next_score"))
    out = keys.join(listed, ["audit_id", "key"], "left")
    confidence = F.when(F.col("file").isNull(), "none").when(F.col("next_score").isNull(), "high").when(F.col("score") - F.col("next_score") >= 3, "medium").otherwise("none")
    told = F.col("confidence") != "none"
    out = out.withColumn("confidence", confidence)
    reason = F.when(F.col("file").isNull(), "代码里没有任何该参数的赋值点").when(F.col("confidence") == "high", "代码里只有一处赋值").when(F.col("confidence") == "medium", "多处赋值, 首位最可能最终生效; 启发式判断, 建议实际运行核对").otherwise("多处赋值, 无从判断哪一处最终生效")
    return out.select("audit_id", "key", "seq", F.when(told, F.col("value")).alias("verdict"), F.when(told, F.concat("file", F.lit(":"), "line")).alias("verdict_loc"), F.when(told, F.col("file")).alias("file"), F.when(told, F.col("line")).alias("line"), "confidence", reason.alias("reason"), "candidates")


def safe_literal(raw: str, num: float | None, key: str) -> str | None:
    """What a line of code may hold for a claimed value; None if that is in doubt."""
    if key == "dataset":
        return repr(raw) if re.fullmatch(r"[\w .\-]+", raw) else None
    if num is None:
        return None
    return str(int(num)) if float(num).is_integer() and abs(num) < 1e15 and not re.search(r"[.eE]", raw) else repr(float(num))


def replace_token(line: str, old: str, new: str) -> tuple[str | None, str]:
    """Replace the one token of a line that equals a value, comments aside; (line, "") or (None, why)."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(line.strip() + "\n").readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        tokens = []
    shift = len(line) - len(line.lstrip())

    def equal(t: str) -> bool:
        try:
            return float(t) == float(old)
        except ValueError:
            return t == old or t.strip("'\"") == old

    hits = [t for t in tokens if t.type in (tokenize.NUMBER, tokenize.STRING) and equal(t.string)]
    if len(hits) != 1:
        return None, "no_token" if not hits else "ambiguous_token"
    a, b = hits[0].start[1] + shift, hits[0].end[1] + shift
    return line[:a] + new + line[b:], ""


def still_parses(before: str, after: str) -> bool:
    """Whether a changed line parses wherever the line itself did."""
    body = lambda s: s.strip() + ("\n  pass" if s.strip().endswith(":") else "")
    try:
        ast.parse(body(before))
    except SyntaxError:
        return True
    try:
        ast.parse(body(after))
    except SyntaxError:
        return False
    return True


def patches(findings: DataFrame, trace: DataFrame, lines: DataFrame, claims: DataFrame, by: str = "rule") -> DataFrame:
    """A draft or a refusal for each traced finding. ``lines`` are (audit_id, file, line, text). The gates are tried in order."""
    several = claims.filter(~F.col("excluded")).groupBy("audit_id", "key").agg(F.countDistinct(value_text()).alias("n_values"))
    # all sides grow with the audits: none is sent whole to every task, however small its file
    rows = trace.join(findings.select("audit_id", "key", "seq", "status", "paper").hint("merge"), ["audit_id", "key", "seq"])
    rows = rows.join(several.hint("merge"), ["audit_id", "key"], "left").join(_around(trace, lines).hint("merge"), ["audit_id", "file", "line"], "left")
    rows = rows.withColumn("before", F.get(F.filter("near", lambda x: x["at"] == F.col("line")), F.lit(0))["text"])
    raw = F.col("paper.raw_value")
    epochs, steps = "(?i)epoch", "(?i)iteration|step"
    unit = (F.col("before").rlike(epochs) & F.concat_ws(" ", "paper.snippet", raw).rlike(r"(?i)\biterations?\b|\bsteps?\b") & F.col("key").isin("warmup", "epochs")) | (F.col("before").rlike(steps) & F.col("paper.snippet").rlike(r"(?i)\bepochs?\b") & F.col("key").isin("warmup", "iterations"))

    @F.pandas_udf("literal string, after string, why string")
    def draft(raw: pd.Series, num: pd.Series, key: pd.Series, before: pd.Series, old: pd.Series) -> pd.DataFrame:
        out = []
        for r, n, k, b, o in zip(raw, num, key, before, old, strict=True):
            literal = safe_literal(r, None if n is None or n != n else n, k) if isinstance(r, str) else None
            after, why = replace_token(b, o, literal) if literal is not None and isinstance(b, str) and isinstance(o, str) else (None, "")
            if after is not None and not still_parses(b, after):
                after, why = None, "syntax"
            out.append((literal, after, why))
        return pd.DataFrame(out, columns=["literal", "after", "why"])

    drafted = rows.withColumn("d", draft(raw, F.col("paper.num"), F.col("key"), F.col("before"), F.col("verdict")))
    gates = [
        ("not_inconsistent", F.col("status") != "inconsistent"),
        ("not_config", ~F.col("key").isin(*PATCHABLE)),
        ("multi_value", F.coalesce("n_values", F.lit(1)) > 1),
        ("no_rootcause", F.col("confidence") == "none"),
        ("no_paper_value", F.coalesce(raw, F.lit("")) == ""),
        ("malformed", raw.rlike(r"[.,;:，。、；]$|^[.,;:，。、]|^\s*$")),
        ("literal", F.col("d.literal").isNull()),
        ("bad_target", F.col("before").isNull()),
        ("unit", F.coalesce(unit, F.lit(False))),
        ("type_int", F.col("before").rlike(r"type\s*=\s*int\b") & F.col("d.literal").rlike("[.eE]")),
        ("token", F.col("d.why").isin("no_token", "ambiguous_token")),
        ("syntax", F.col("d.why") == "syntax"),
    ]
    out = drafted.withColumn("refuse_kind", V.first_reason(gates))
    ok = F.col("refuse_kind").isNull()
    after = F.when(ok, F.col("d.after"))
    told = [F.when(ok, "proposed").otherwise("refused").alias("status"), F.coalesce("refuse_kind", F.lit("")).alias("refuse_kind"), F.col("verdict_loc").alias("target")]
    return out.select("audit_id", "key", *told, "before", after.alias("after"), F.when(after.isNotNull(), _hunk(after)).alias("diff"), F.lit(by).alias("source"), F.lit(True).alias("needs_human"))


def _around(trace: DataFrame, lines: DataFrame, around: int = AROUND) -> DataFrame:
    """(audit_id, file, line, near): the lines up to ``around`` before and after each place of a trace, in their order. The places are repeated, not the code."""
    places = trace.filter("line is not null").select("audit_id", "file", "line", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("at"))
    met = places.join(lines.select("audit_id", "file", F.col("line").alias("at"), "text").hint("merge"), ["audit_id", "file", "at"])
    return met.groupBy("audit_id", "file", "line").agg(F.array_sort(F.collect_set(F.struct("at", "text"))).alias("near"))


def _hunk(after: Column) -> Column:
    """The change of a line as a unified diff with the lines near it."""
    same = lambda holds: F.transform(F.filter("near", holds), lambda x: F.concat(F.lit(" "), x["text"]))
    body = F.concat_ws("\n", same(lambda x: x["at"] < F.col("line")), F.concat(F.lit("-"), "before"), F.concat(F.lit("+"), after), same(lambda x: x["at"] > F.col("line")))
    span = F.concat(F.get("near", F.lit(0))["at"], F.lit(","), F.size("near"))
    return F.concat(F.lit("--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -"), span, F.lit(" +"), span, F.lit(" @@\n"), body)


def nominated(nominations: DataFrame, claims: DataFrame, code: DataFrame) -> DataFrame:
    """Nominations (audit_id, key, value, file, line) whose value a claim has and whose place is a site: the others are dropped.
    What stays goes through the same gates as a trace."""
    values = claims.select("audit_id", "key", F.col("raw_value").alias("value")).distinct()
    places = sites(code).select("audit_id", "key", "file", "line", F.col("value").alias("verdict"))
    kept = nominations.join(values, ["audit_id", "key", "value"], "left_semi")
    return kept.join(places, ["audit_id", "key", "file", "line"])


def nominated_patches(nominations: DataFrame, findings: DataFrame, claims: DataFrame, code: DataFrame, lines: DataFrame) -> DataFrame:
    """Drafts for what an outside model nominates, through the same gates as those of the rules; a person has to agree."""
    kept = nominated(nominations, claims, code)
    first = findings.filter("status = 'inconsistent'").groupBy("audit_id", "key").agg(F.min("seq").alias("seq"))
    shadow = kept.join(first, ["audit_id", "key"]).select("audit_id", "key", "seq", "verdict", F.concat("file", F.lit(":"), "line").alias("verdict_loc"), "file", "line", F.lit("medium").alias("confidence"))
    return patches(findings, shadow, lines, claims, "model")
