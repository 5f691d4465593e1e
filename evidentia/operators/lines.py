"""Alignment of two lists of lines, many pairs of lists at once: equal lines in equal order, what lies between them, and unified hunks.

Pairs of lists with at most ``SHORT`` lines together are sorted by one shuffle and told one after another; longer ones are cut by joins, by the same steps.

Anchors are lines that occur once on both sides of a block (a hash join); of these the longest run that rises on both sides is kept, which
cuts the block into smaller ones, where other lines may occur once. Equal lines at a block's start and end are matched as well, and in blocks whose
sides have at most ``SMALL`` pairs the longest common sequence. This repeats until nothing is added; what is left has changed. (In larger blocks where no line
occurs once on both sides, equal lines may so be told as gone and come.)
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.folders import at_rest, scratch

AROUND, SMALL, SHORT = 3, 250_000, 1_000


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (a, b), each side without repeats, that rises in both."""
    pairs = sorted(pairs)
    tops: list[int] = []  # the least b that ends a run of each length, and its place
    places: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[i] = places[k - 1] if k else -1
        tops[k : k + 1], places[k : k + 1] = [b], [i]
    kept, i = [], places[-1] if places else -1
    while i >= 0:
        kept.append(i)
        i = before[i]
    return [pairs[i] for i in kept[::-1]]


def _blocks(lines: DataFrame, pairs: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Lines of a side without partner, with the number of pairs before each."""
    met = lines.join(pairs.select(*keys, F.col(side).alias("n"), F.lit(1).alias("_p")), [*keys, "n"], "left")
    order = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("block", F.coalesce(F.sum("_p").over(order), F.lit(0))).filter("_p is null").drop("_p")


def _ends(a: DataFrame, b: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Pairs of equal lines from the starts (or the ends) of blocks on."""
    group = [*keys, "block"]
    order = Window.partitionBy(*group).orderBy(F.desc("n") if last else F.asc("n"))
    numbered = lambda df, name: df.withColumn("i", F.row_number().over(order)).select(*group, "i", F.col("n").alias(name), F.col("line").alias(f"_{name}"))
    both = numbered(a, "a").join(numbered(b, "b"), [*group, "i"])
    so_far = F.min((F.col("_a") == F.col("_b")).cast("int")).over(Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_same", so_far).filter("_same = 1").select(*keys, "a", "b")


def _anchors(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rising pairs of lines that occur once on both sides of a block."""
    group = [*keys, "block"]
    once = lambda df, name: df.groupBy(*group, "line").agg(F.count("*").alias("_n"), F.min("n").alias(name)).filter("_n = 1").drop("_n")
    met = once(a, "a").join(once(b, "b"), [*group, "line"]).select(*group, "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = rising(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)))
        return pdf.set_index(["a", "b"], drop=False).loc[pairs] if pairs else pdf.iloc[:0]

    kept = met.groupBy(*group).applyInPandas(run, met.schema)  # anchors of one block: two numbers a line
    return kept.select(*keys, "a", "b")


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """The places of a longest common sequence."""
    longest = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], longest[-1]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        longest.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif longest[i - 1][j] >= longest[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _small(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Longest common sequences of blocks that are small on both sides."""
    group = [*keys, "block"]
    counts = lambda df, name: df.groupBy(*group).agg(F.count("*").alias(name))
    small = counts(a, "_a").join(counts(b, "_b"), group).filter(F.col("_a") * F.col("_b") <= SMALL).drop("_a", "_b")
    listed = lambda df, name: df.join(small, group, "left_semi").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias(name))
    both = listed(a, "xs").join(listed(b, "ys"), group).select(*keys, F.col("xs.n").alias("an"), F.col("xs.line").alias("al"), F.col("ys.n").alias("bn"), F.col("ys.line").alias("bl"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, int(an[i]), int(bn[j])) for *k, an, al, bn, bl in pdf.itertuples(index=False, name=None) for i, j in common(list(al), list(bl))]
            yield pd.DataFrame(rows, columns=[*keys, "a", "b"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in a.dtypes if k in keys)
    return both.mapInPandas(solve, f"{kinds}, a bigint, b bigint")


def _align(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_k, a, b): the line numbers of equal lines, rising on both sides, of long lists (_k, n, line)."""
    spark, inner = old.sparkSession, ["_k"]
    folder = scratch(spark, "lines")
    a, b = at_rest(old, f"{folder}/old"), at_rest(new, f"{folder}/new")
    pairs = a.select(*inner, F.col("n").alias("a"), F.col("n").alias("b")).limit(0)
    finders = (lambda x, y: _ends(x, y, inner, False), lambda x, y: _ends(x, y, inner, True), lambda x, y: _anchors(x, y, inner), lambda x, y: _small(x, y, inner))
    idle, turn = 0, 0
    while idle < len(finders):  # until each in turn has found nothing
        found = at_rest(finders[turn % len(finders)](_blocks(a, pairs, inner, "a"), _blocks(b, pairs, inner, "b")), f"{folder}/{turn}")
        idle, turn = (idle + 1 if found.isEmpty() else 0), turn + 1
        if not idle:
            pairs = pairs.unionByName(found)
    return pairs


def short_pairs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """The places of equal lines of two short lists: equal starts, equal ends, anchors, and longest common sequences between them. (No block has an equal line left then.)"""
    start, la, lb = 0, len(a), len(b)
    while start < la and start < lb and a[start] == b[start]:
        start += 1
    while start < la and start < lb and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    once = lambda x, end: {line: i for i, line in enumerate(x[start:end], start) if counts[line] == 1}
    counts = Counter(a[start:la])
    in_a = once(a, la)
    counts = Counter(b[start:lb])
    in_b = once(b, lb)
    anchors = rising([(i, in_b[line]) for line, i in in_a.items() if line in in_b])
    out, i, j = [(k, k) for k in range(start)], start, start
    for x, y in [*anchors, (la, lb)]:
        if i < x and j < y and not set(a[i:x]).isdisjoint(b[j:y]):
            out += [(i + m, j + n) for m, n in common(a[i:x], b[j:y])]
        if x < la:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out + [(la + k, lb + k) for k in range(len(a) - la)]


def _told(keys: tuple, a: list[tuple[int, str]], b: list[tuple[int, str]]) -> Iterator[tuple]:
    """Rows of ``changes`` of two short lists of (number, line)."""
    i = j = seq = 0
    for x, y in [*short_pairs([t for _, t in a], [t for _, t in b]), (len(a), len(b))]:
        rows = [("-", n, None, t) for n, t in a[i:x]] + [("+", None, n, t) for n, t in b[j:y]]
        if x < len(a):
            rows.append((" ", a[x][0], b[y][0], a[x][1]))
        for row in rows:
            seq += 1
            yield (*keys, seq, *row)
        i, j = x + 1, y + 1


def _short(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` of sorted (keys, _s, n, line); lines of lists that are longer than ``SHORT`` together come back as they are, with their side as kind."""
    types = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    width = len(keys)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = [("seq", pa.int32()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("line", pa.string())]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[name for name, _ in schema])
        raw = lambda k, s, n, t: (*k, None, "old" if s == 0 else "new", n, None, t)
        now, held, long, out = None, ([], []), False, []
        for rows in batches:
            schema = [(f.name, f.type) for f in rows.schema][:width] + form
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                k, (s, n, t) = row[:width], row[width:]
                if k != now:
                    if now is not None and not long:
                        out += _told(now, *held)
                    now, held, long = k, ([], []), False
                if not long and len(held[0]) + len(held[1]) == SHORT:
                    out += [raw(k, side, *x) for side in (0, 1) for x in held[side]]
                    held, long = ([], []), True
                if long:
                    out.append(raw(k, s, n, t))
                else:
                    held[s].append((n, t))
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
        if now is not None and not long:
            out += _told(now, *held)
        if out:
            yield batch(out)

    # by a hash, not by the keys: where both sides of a union are parted by them already, that shuffle would be left out, and adaptive execution merges partitions of each side by itself
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "_s", "n").mapInArrow(tell, f"{types}, seq int, kind string, a bigint, b bigint, line string")


def align(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b): the line numbers of equal lines, rising on both sides, of lists (keys, line_no, line). ``keys`` tell which lists belong together;
    a null line counts as an empty one."""
    return changes(old, new, keys).filter("kind = ' '").select(*keys, "a", "b")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both lists as one: (keys, seq, kind, a, b, line) in order, with ``-`` for lines that went, ``+`` for those that came, and a space for equal ones.
    A null key is a key."""
    keys = [*keys]
    inner = keys or ["_one"]
    named = lambda df, side: df.withColumn("_one", F.lit(0)).select(*inner, F.lit(side).alias("_s"), F.col("line_no").cast("long").alias("n"), F.coalesce("line", F.lit("")).alias("line"))
    folder = scratch(old.sparkSession, "changes")
    every = at_rest(_short(named(old, 0).unionByName(named(new, 1)), inner), f"{folder}/short")
    told = every.filter("kind in ('-', '+', ' ')").select(*keys, "seq", "kind", "a", "b", "line")
    rest = every.filter("kind in ('old', 'new')")
    if rest.isEmpty():
        return told
    lists = at_rest(rest.select(*inner).distinct().withColumn("_k", F.monotonically_increasing_id()), f"{folder}/lists").select("_k", *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(inner)])
    of = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(inner)])
    rest = at_rest(rest.join(lists, of).select("_k", "kind", F.col("a").alias("n"), "line"), f"{folder}/long")
    long = _long(rest.filter("kind = 'old'").drop("kind"), rest.filter("kind = 'new'").drop("kind")).join(lists, "_k")
    return told.unionByName(long.select(*[F.col(f"_k_{i}").alias(k) for i, k in enumerate(keys)], "seq", "kind", "a", "b", "line"))


def _long(old: DataFrame, new: DataFrame) -> DataFrame:
    """``changes`` of long lists (_k, n, line)."""
    pairs, inner = _align(old, new), ["_k"]
    none = F.lit(None).cast("long")
    place = Window.partitionBy(*inner).orderBy("a")
    equal = old.withColumnRenamed("n", "a").join(pairs, [*inner, "a"])
    equal = equal.withColumn("block", F.row_number().over(place) - 1).select(*inner, F.col("block").cast("long").alias("block"), F.lit(2).alias("o"), F.lit(" ").alias("kind"), "a", "b", "line")
    gone = _blocks(old, pairs, inner, "a").select(*inner, F.col("block").cast("long").alias("block"), F.lit(0).alias("o"), F.lit("-").alias("kind"), F.col("n").alias("a"), none.alias("b"), "line")
    came = _blocks(new, pairs, inner, "b").select(*inner, F.col("block").cast("long").alias("block"), F.lit(1).alias("o"), F.lit("+").alias("kind"), none.alias("a"), F.col("n").alias("b"), "line")
    every = equal.unionByName(gone).unionByName(came)
    order = Window.partitionBy(*inner).orderBy("block", "o", F.coalesce("a", "b"))
    return every.withColumn("seq", F.row_number().over(order))


def _span(first: Column, count: Column) -> Column:
    return F.when(count == 1, first.cast("string")).otherwise(F.concat(first, F.lit(","), count))


def hunks(old: DataFrame, new: DataFrame, keys: Sequence[str] = (), around: int = AROUND) -> DataFrame:
    """(keys, hunk, diff): unified hunks with ``around`` lines before and after; changes that are closer together share one. Line numbers of the lists begin at 1."""
    keys = [*keys]
    inner = keys or ["_one"]
    rows = changes(old, new, keys).withColumn("_one", F.lit(0))
    order = Window.partitionBy(*inner).orderBy("seq")
    changed = F.when(F.col("kind") != " ", F.col("seq"))
    near = (F.col("seq") - F.max(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)) <= around) | (F.min(changed).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("seq") <= around)
    # lines of each side before a row, for hunks that hold none of a side
    rows = rows.withColumn("old_before", F.count("a").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new_before", F.count("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    shown = rows.filter(F.col("seq").isNotNull()).withColumn("_near", F.coalesce(near, F.lit(False))).filter("_near")
    begins = F.col("seq") - F.lag("seq").over(order) != 1
    shown = shown.withColumn("hunk", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = shown.groupBy(*inner, "hunk").agg(
        F.min("old_before").alias("a0"), F.count("a").alias("na"), F.min("new_before").alias("b0"), F.count("b").alias("nb"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("kind", "line").alias("t")))), lambda x: x["t"]), "\n").alias("body"),
    )
    first = lambda before, n: F.when(n == 0, before).otherwise(before + 1)
    head = F.concat(F.lit("@@ -"), _span(first(F.col("a0"), F.col("na")), F.col("na")), F.lit(" +"), _span(first(F.col("b0"), F.col("nb")), F.col("nb")), F.lit(" @@\n"))
    return told.select(*keys, "hunk", F.concat(head, "body").alias("diff"))
