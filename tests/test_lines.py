"""Alignment of line lists against difflib, replay of changes, and unified hunks."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from evidentia.operators.lines import align, changes, hunks
from evidentia.sinks.report import line_diff

LINES = "k string, line_no int, line string"


def edited(rng, lines, fresh):
    out = []
    for x in lines:
        r = rng.random()
        if r < 0.06:
            continue
        if r < 0.12:
            out.append(f"new {next(fresh)}")
            continue
        if r < 0.2:
            out += [f"more {next(fresh)}" for _ in range(rng.randint(1, 3))]
        out.append(x)
    return out


def pairs_of_lists(rng, unique):
    fresh = iter(range(10**6))
    for k in range(40):
        n = rng.choice([0, 1, 2, 30, 80])
        old = [f"line {i}" if unique else rng.choice(["", "}", f"line {i}", "x"]) for i in range(n)]
        yield f"k{k}", old, edited(rng, old, fresh)
    yield "gone", ["a", "b"], []
    yield "came", [], ["a", "b"]
    yield "moved", ["a", "b", "c", "d", "e"], ["d", "a", "b", "c", "e"]


def tables(spark, lists, side):
    return spark.createDataFrame([(x[0], i, line) for x in lists for i, line in enumerate(x[side], 1)], LINES).repartition(4)


def test_changes_equal_difflib(spark):
    lists = list(pairs_of_lists(random.Random(2), unique=True))
    got = {}
    for r in changes(tables(spark, lists, 1), tables(spark, lists, 2), ["k"]).collect():
        got.setdefault(r["k"], []).append((r["seq"], r["kind"], r["line"]))
    for k, old, new in lists:
        rows = [x[1:] for x in sorted(got.get(k, []))]
        assert [line for kind, line in rows if kind != "+"] == old and [line for kind, line in rows if kind != "-"] == new
        want = [(d[0], d[2:]) for d in difflib.ndiff(old, new, charjunk=None) if d[0] != "?"]
        assert sorted(x for x in rows if x[0] != " ") == sorted(x for x in want if x[0] != " ")


def test_repeated_lines(spark):
    """Lines that occur many times: the changes replay, and are not more than difflib's by much."""
    lists = list(pairs_of_lists(random.Random(3), unique=False))
    got = {}
    for r in changes(tables(spark, lists, 1), tables(spark, lists, 2), ["k"]).collect():
        got.setdefault(r["k"], []).append((r["seq"], r["kind"], r["line"], r["a"], r["b"]))
    ours = theirs = 0
    for k, old, new in lists:
        rows = sorted(got.get(k, []))
        assert [x[2] for x in rows if x[1] != "+"] == old and [x[2] for x in rows if x[1] != "-"] == new
        assert [x[3] for x in rows if x[3]] == list(range(1, len(old) + 1)) and [x[4] for x in rows if x[4]] == list(range(1, len(new) + 1))
        ours += sum(x[1] != " " for x in rows)
        blocks = difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()
        theirs += len(old) + len(new) - 2 * sum(m.size for m in blocks)
    assert ours <= 1.15 * theirs


def test_hunks(spark):
    lists = list(pairs_of_lists(random.Random(4), unique=True))
    got = {}
    for r in hunks(tables(spark, lists, 1), tables(spark, lists, 2), ["k"]).collect():
        got.setdefault(r["k"], []).append((r["hunk"], r["diff"]))
    for k, old, new in lists:
        if k == "moved":
            continue
        want = "\n".join(list(difflib.unified_diff(old, new, lineterm=""))[2:])
        text = "\n".join(d for _, d in sorted(got.get(k, [])))
        if sorted(text.split("\n")) != sorted(want.split("\n")):  # the same hunks; in a replaced run the order of - and + may differ
            raise AssertionError((k, text, want))


def test_without_keys_and_masks(spark):
    one = lambda lines: spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")
    old = one(["start", "took 1.5 s", None, "end"])
    new = one(["start", "inserted", "took 9.25 s", None, "end"])
    assert [(r["kind"], r["a"], r["b"], r["line"]) for r in line_diff(old, new).collect()] == [("+", None, 2, "inserted")]
    assert line_diff(old, old).count() == 0 and align(old.limit(0), new).count() == 0
    assert hunks(old, new).select(F.col("diff")).first()[0] == "@@ -1,4 +1,5 @@\n start\n-took 1.5 s\n+inserted\n+took 9.25 s\n \n end"
