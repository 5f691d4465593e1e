"""Values, guards and kernels."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import values as V
from evidentia.operators import generic as G


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1e-4", 1e-4), ("0.0001", 1e-4), ("10^-4", 1e-4), ("10⁻⁴", 1e-4), ("1×10⁻⁴", 1e-4), ("10−4", 1e-4), ("5 × 10−4", 5e-4), ("500K", 5e5), ("1.5M", 1.5e6), ("1,500", 1500), ("94.3%", 94.3), ("32", 32), ("100", 100), ("1000", 1000), ("1024", 1024), ("-3", -3), (".5", 0.5)],
)
def test_numbers(spark, raw, want):
    assert one(spark, V.normalize_number(F.lit(raw))) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("raw", ["", "abc", "1d", "NaN", "Smith, 2020", "1.2.3", None])
def test_no_numbers(spark, raw):
    assert one(spark, V.normalize_number(F.lit(raw).cast("string"))) is None


def test_comparison(spark):
    same = lambda a, b: one(spark, V.values_equal(F.lit(a), F.lit(b)))
    assert same("1e-4", "0.0001") and not same("0", "1e-12") and same("Cosine Annealing", "cosine_annealing") and not same("100", "1000")
    assert one(spark, V.numbers_equal(F.lit(None).cast("double"), F.lit(1.0))) is None
    match = lambda a, b: one(spark, V.text_match(F.lit(a), F.lit(b)))
    assert match("adam", "AdamW") and not match("3", "32") and not match("", "x")


def test_keys_and_ranges(spark):
    key = lambda n: one(spark, V.canonical_key(F.lit(n)))
    assert key("args.LR") == "learning_rate" and key("mini-batch") == "batch_size" and key("学习率") == "learning_rate" and key("rng") is None
    fit = lambda k, v: one(spark, V.is_plausible(F.lit(k), F.lit(v)))
    assert fit("learning_rate", "2024") is False and fit("learning_rate", "1") is True and fit("epochs", "1.5") is False and fit("model", "5") is None and fit("epochs", "x") is None


def test_places(spark):
    assert one(spark, V.location_line(F.lit("a/b.py:12"))) == 12
    assert one(spark, V.location_page(F.lit("Page 3 · Setup"))) == 3
    assert one(spark, V.occurrences(F.lit("COCO and coco"), F.lit("coco"))) == 2
    assert one(spark, V.language_of(F.lit("x/Y.JL"))) == "Julia"


def test_kernels(spark):
    df = spark.createDataFrame([("a", 5.0, 1), ("a", 9.0, 2), ("b", 1.0, 3), ("b", 0.5, 4), ("c", 7.0, 5)], "k string, v double, i int")
    assert {r["k"]: r["i"] for r in G.best_per_key(df, ["k"], [-F.col("v")], ["i"]).collect()} == {"a": 2, "b": 3, "c": 5}
    assert {r["k"]: r["verdict"] for r in G.rank_gap(df, "k", F.col("v"), ["i"]).collect()} == {"a": "medium", "b": "none", "c": "high"}
    band = lambda a, b: one(spark, G.tolerance_band(F.lit(a), F.lit(b)))
    assert [band(87.3, 87.3), band(87.8, 86.1), band(81.5, 78.0), band(83.1, 83.4)] == ["none", "medium", "high", "none"]
    assert math.isclose(one(spark, F.bround(F.lit(2.5))), 2.0)


def test_grounding_of_short_items(spark, tmp_path):
    """Items of any number of words, whose ends may be parts of words, against brute force."""
    docs = ["the bobcat satin a hat", "one two three four five six seven eight nine", " x  y\nz ", None, "last"]
    items = ["cat sat", "bobcat  satin a", "three four five", "four five six seven eight", "y z", "ast", "dog", "two four", "wo three four fiv", "one two three four five six seven eigh", "seven nine ten", "as", None, "last last"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from evidentia.queries import kernels

    flat = lambda x: " ".join(x.split())
    want = [i for i, t in enumerate(items) if t is not None and any(flat(t) in flat(d) for d in docs if d is not None)]
    assert sorted(r["item_id"] for r in kernels.grounding_semi_join(spark, str(tmp_path)).collect()) == want
