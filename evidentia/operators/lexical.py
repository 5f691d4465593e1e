"""What of a source line is code, in any of the languages of the line channel: strings, line comments and block comments.

A line is scanned for both states that it may begin in, code or block comment; that gives a function of two states, which is a constant, the
identity or an exchange. The state at a line's start is the composition of the functions of all lines before it. As composing is associative, a file is
cut into stretches of ``STRETCH`` lines: windows compose each stretch, then the stretches of a file, then the lines of a stretch, and no task holds more than one stretch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import values as V

STRETCH = 4096
# Marks of block comments by extension, and whether they stand alone on their lines; a line comment begins at //, #, % or --.
C_LIKE = ("c", "cc", "cpp", "cxx", "h", "cu", "java")
BLOCKS = {**{e: ("/*", "*/", False) for e in C_LIKE}, "jl": ("#=", "=#", False), "ps1": ("<#", "#>", False), "m": ("%{", "%}", True)}
LINE_COMMENT = r"(?<![:\"'#/])//|(?<![:\"'#/])#|(?<!%)%(?![0-9a-zA-Z])|(?<!\w)--(?!\w)"

_STRING = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
_SCANNERS = {(o, alone): re.compile(rf"(?P<string>{_STRING})" + (rf"|(?P<block>{re.escape(o)})" if o and not alone else "") + rf"|(?P<line>{LINE_COMMENT})") for o, _, alone in {("", "", False), *BLOCKS.values()}}


def scan_line(line: str, inside: bool, marks: tuple[str, str, bool]) -> tuple[str, bool]:
    """The code of a line, comments as spaces, and whether it ends inside a block comment. A quote that is not closed on its line is no string."""
    first, last, alone = marks
    if alone:
        if inside:
            return "", line.strip() != last
        if line.strip() == first:
            return "", True
    scanner, out, at = _SCANNERS[first, alone], [], 0
    while True:
        if inside:
            end = line.find(last, at)
            if end < 0:
                return "".join(out), True
            out.append(" ")
            at, inside = end + len(last), False
        m = scanner.search(line, at)
        if m is None or m.lastgroup == "line":
            return "".join([*out, line[at : m.start() if m else len(line)]]), False
        if m.lastgroup == "string":
            out.append(line[at : m.end()])
        else:
            out.append(line[at : m.start()])
            inside = True
        at = m.end()


_BOTH = T.StructType().add("as_code", T.StringType()).add("code_ends", T.BooleanType()).add("as_block", T.StringType()).add("block_ends", T.BooleanType())


@F.pandas_udf(_BOTH)
def _both(line: pd.Series, extension: pd.Series) -> pd.DataFrame:
    rows = []
    for text, e in zip(line, extension, strict=True):
        marks = BLOCKS.get(e, ("", "", False))
        rows.append((*scan_line(text, False, marks), *(scan_line(text, True, marks) if marks[0] else ("", False))))
    return pd.DataFrame(rows, columns=["as_code", "code_ends", "as_block", "block_ends"])


def _composed(rows: DataFrame, keys: Sequence[str], order: str, suffix: str) -> DataFrame:
    """Add the state before each row of a group: constant if a row before it is, and whether the exchanges since then are odd."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.col("exchange").cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("_odd", odd)
    # what a constant row ends in, and the exchanges up to and with it
    mark = F.when(F.col("constant").isNotNull(), F.struct(F.col("constant").alias("ends"), F.col("_odd").alias("odd")))
    rows = rows.withColumn("_last", F.last(mark, ignorenulls=True).over(before))
    return rows.withColumn(f"set{suffix}", F.col("_last.ends")).withColumn(f"odd{suffix}", (F.col("_odd") - F.coalesce("_last.odd", F.lit(0))) % 2 == 1).drop("_odd", "_last")


def _after(start: Column, of: str) -> Column:
    return F.when(F.col(f"odd{of}"), ~F.coalesce(F.col(f"set{of}"), start)).otherwise(F.coalesce(F.col(f"set{of}"), start))


def code_of_lines(lines: DataFrame, keys: Sequence[str], path: str = "file") -> DataFrame:
    """Add ``code`` to lines (keys, path, line_no, line): the line without comments. Lines of a file are numbered from 0 without gaps."""
    keys = [*keys]
    rows = lines.withColumn("_b", _both(F.coalesce("line", F.lit("")), F.substring(V.extension(F.col(path)), 2, 9))).withColumn("_stretch", F.floor(F.col("line_no") / STRETCH))
    rows = rows.withColumn("constant", F.when(F.col("_b.code_ends") == F.col("_b.block_ends"), F.col("_b.code_ends"))).withColumn("exchange", F.col("_b.code_ends") & ~F.col("_b.block_ends"))
    rows = _composed(rows, [*keys, "_stretch"], "line_no", "_line")
    # the function of a whole stretch: that before its last line, then its last line
    ends = lambda start: F.when(_after(start, "_line"), F.col("_b.block_ends")).otherwise(F.col("_b.code_ends"))
    whole = rows.groupBy(*keys, "_stretch").agg(F.max_by(F.struct(ends(F.lit(False)).alias("c"), ends(F.lit(True)).alias("b")), "line_no").alias("f"))
    whole = whole.select(*keys, "_stretch", F.when(F.col("f.c") == F.col("f.b"), F.col("f.c")).alias("constant"), (F.col("f.c") & ~F.col("f.b")).alias("exchange"))
    starts = _composed(whole, keys, "_stretch", "_file").select(*keys, "_stretch", _after(F.lit(False), "_file").alias("_start"))
    placed = rows.alias("a").join(starts.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_stretch"]]).select("a.*", "b._start")
    return placed.withColumn("code", F.when(_after(F.col("_start"), "_line"), F.col("_b.as_block")).otherwise(F.col("_b.as_code"))).select(*lines.columns, "code")
