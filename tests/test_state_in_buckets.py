"""The state of a stream's keys lies in buckets: no operator with state, no file more than there are buckets, nothing twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.operators import memory
from evidentia.sinks.buckets import BucketStore
from evidentia.streaming.incremental import current_evidence, current_memory, keep_memory, memory_store, page_stream, pages_store, watch
from evidentia.streaming.state import PAGES, clue_rows, merge_memory, merge_pages, page_rows

CLUES = "owner string, fp string, title string, runs int, last_seen timestamp, unresolved array<string>, page_hints map<string,array<int>>, scheme int"


def clues(spark, *rows):
    names = "owner string, fp string, title string, runs int, s int, unresolved array<string>, page_hints map<string,array<int>>"
    return spark.createDataFrame(list(rows), names).select("owner", "fp", "title", "runs", F.timestamp_seconds("s").alias("last_seen"), "unresolved", "page_hints", F.lit(memory.SCHEME).alias("scheme"))


def test_memory_without_state_operators(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    clues(spark, *[(f"o{i % 3}", f"p{i}", "t", 1, i, ["seed"], {"seed": [i]}) for i in range(30)]).coalesce(1).write.parquet(folder)
    query = keep_memory(spark.readStream.schema(CLUES).parquet(folder), out, state, keep=2, buckets=4)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    detail, digests = current_memory(spark, out, 4)
    assert sorted((r["owner"], r["fp"]) for r in detail.collect()) == sorted((f"o{i % 3}", f"p{i}") for i in range(24, 30))
    assert sorted((r["owner"], r["key"], r["times"], tuple(r["pages"])) for r in digests.collect()) == [(f"o{o}", "seed", 8, tuple(range(o, 24, 3))) for o in range(3)]


def test_repeated_batch_and_odd_clues(spark, tmp_path):
    """A batch that comes again counts nothing twice; the next one adds. Nulls in hints and open keys, and equal times, are told apart for certain."""
    store = BucketStore(f"file://{tmp_path}/m", memory_store("x").schema, ("owner",), 2)
    first = clue_rows(clues(spark, ("a", "p", None, 1, 5, None, None), ("a", "p", "z", 1, 5, ["lr"], {"lr": [3, 3, 1]}), ("a", "q", "t", 1, None, ["lr", "seed"], {"lr": [*range(20), None], "bs": None}), ("b", "p", "t", 2, 1, [], {})))
    for _ in range(2):
        now = store.read(spark, store.touched(first))
        store.rewrite(merge_memory(now, first, "stream/0", keep=1), store.touched(first))
        rows = {(r["owner"], r["kind"], r["name"]): r for r in store.read(spark).collect()}
        assert {k: r["runs"] for k, r in rows.items() if k[1] == "entry"} == {("a", "entry", "p"): 2, ("b", "entry", "p"): 2}
        assert rows["a", "entry", "p"]["title"] == "z" and {r["folded"] for k, r in rows.items() if k[0] == "a"} == {1}
        assert {k[2]: (r["times"], r["pages"]) for k, r in rows.items() if k[1] == "digest"} == {"lr": (1, list(range(12))), "seed": (1, []), "bs": (0, [])}
    later = clue_rows(clues(spark, ("a", "r", "t", 1, 9, ["lr"], {})))
    store.rewrite(merge_memory(store.read(spark, store.touched(later)), later, "stream/1", keep=1), store.touched(later))
    rows = {(r["owner"], r["kind"], r["name"]): r for r in store.read(spark).collect()}
    assert {k for k in rows if k[1] == "entry"} == {("a", "entry", "r"), ("b", "entry", "p")}
    assert (rows["a", "digest", "lr"]["times"], rows["a", "digest", "lr"]["pages"], rows["a", "digest", "lr"]["folded"]) == (2, list(range(12)), 2)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_bucket_is_a_file(spark, tmp_path, adaptive):
    store = BucketStore(f"file://{tmp_path}/t", "k int, v int", ("k",), 8)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        store.upsert(spark.range(4000).repartition(6).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v")), F.col("v"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 8 and store.read(spark).count() == 4000


def test_pages_without_state_operators(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.createDataFrame([("P", 1, "All models are trained for 30 epochs.", 0, 0)], PAGES).drop("version").write.parquet(folder)
    query = watch(page_stream(spark, folder), out, state, buckets=2)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert [(r["owner_id"], r["key"], r["raw_value"]) for r in current_evidence(spark, out, 2).collect()] == [("P", "epochs", "30")]


def test_pages_of_a_repeated_batch(spark, tmp_path):
    """A batch that comes again gives the pages that it gave; the same pages in another batch give none; others' pages stay as they are."""
    store = BucketStore(f"file://{tmp_path}/p", pages_store("x").schema, ("paper_id",), 2)
    pages = lambda *rows: page_rows(spark.createDataFrame(list(rows), PAGES))

    def put(fresh, mark):
        touched = store.touched(fresh)
        store.rewrite(merge_pages(store.read(spark, touched), fresh, mark), touched)
        return sorted((r["paper_id"], r["page_no"], r["text"], r["n_images"], r["version"]) for r in store.read(spark).filter(F.col("batch") == mark).collect())

    first = pages(("P", 1, "a", 0, 1), ("P", 2, None, None, None), ("Q", 1, "x", 0, 1), (None, 1, "x", 0, 1), ("P", None, "x", 0, 1))
    assert put(first, "s/0") == [("P", 1, "a", 0, 1), ("P", 2, "", 0, 0), ("Q", 1, "x", 0, 1)]
    second = pages(("P", 1, "b", 0, 1), ("P", 1, "c", 0, 0), ("Q", 1, "w", 0, 1))  # of Q an older text
    for _ in range(2):
        assert put(second, "s/1") == [("P", 1, "b", 0, 1), ("P", 2, "", 0, 0)]
    assert put(first, "s/2") == [] and store.read(spark).count() == 3
