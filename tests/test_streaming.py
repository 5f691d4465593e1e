"""Pages and clues that arrive in batches give what they give at once, at a cost that does not grow; keyed tables in buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import generic, memory
from evidentia.operators.extract_paper import paper_evidence
from evidentia.schemas import MEMORY
from evidentia.sinks.buckets import BucketStore
from evidentia.sources.paper import cached, html_table_cells, pages_from_text, put_cache
from evidentia.streaming.incremental import current_evidence, current_memory, evidence_store, keep_memory, page_stream, watch
from evidentia.streaming.state import PAGES as VERSIONED

from .samples import PAGES


def evidence_rows(df):
    return sorted((r["owner_id"], r["key"], r["page"], r["raw_value"], r["ordinal"]) for r in df.collect())


def test_watch(spark, tmp_path):
    """The last page comes first, other papers come and go; a batch reads the papers it touches."""
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    pages = pages_from_text(spark, {"P": PAGES, **{f"Q{i}": PAGES[:1] for i in range(12)}}).persist()
    seen = []
    for part in ("page_no = 3 or paper_id < 'Q5' and paper_id <> 'P'", "page_no < 3 and paper_id = 'P'", "paper_id >= 'Q5'"):
        pages.filter(part).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):  # the second run has nothing new to read
            query = watch(page_stream(spark, folder), out, state, lambda found, n: seen.append(spark.read.parquet(f"{out}/arrived").count()), buckets=4)
            query.awaitTermination()
    assert evidence_rows(current_evidence(spark, out, 4)) == evidence_rows(paper_evidence(pages)["evidence"])
    assert {r["key"] for r in current_evidence(spark, out, 4).collect()} >= {"learning_rate", "batch_size", "epochs", "optimizer"}
    first = pages.filter("page_no = 3 or paper_id < 'Q5' and paper_id <> 'P'").count()
    assert seen == [first, 3, pages.filter("paper_id >= 'Q5'").count()]  # the second batch reads the three pages of P alone


def test_watch_late_repeated_and_changed_pages(spark, tmp_path):
    text = lambda n: f"We use a batch size of {n} here."
    rows = [("P", 1, text(16), 0, 1), ("P", 1, text(32), 0, 2), ("P", 2, "All models are trained for 30 epochs.", 0, 1), ("P", 1, text(8), 0, 1), ("Q", 1, text(64), 0, 1), ("Q", 1, "nothing", 0, 2), ("R", 1, None, None, 1), ("R", None, "x", 0, 1), (None, 1, "x", 0, 1)]
    want = None
    for seed, cuts in enumerate(([9], [3, 6, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9])):
        order = rows[:]
        random.Random(seed).shuffle(order)
        folder, out, state = (f"file://{tmp_path}/{seed}/{x}" for x in ("in", "out", "state"))
        for a, b in zip([0, *cuts], cuts):
            spark.createDataFrame(order[a:b], VERSIONED).coalesce(1).write.mode("append").parquet(folder)
            watch(page_stream(spark, folder, versions=True), out, state, buckets=2).awaitTermination()
        found = evidence_rows(current_evidence(spark, out, 2))
        want = want or found
        assert found == want and [r[:4] for r in found] == [("P", "batch_size", 1, "32"), ("P", "epochs", 2, "30")]  # Q has no evidence any more
    # what is there already changes nothing: no bucket is rewritten
    before = evidence_store(out, 2).newest(spark)
    spark.createDataFrame(rows[1:3], VERSIONED).write.mode("append").parquet(folder)
    watch(page_stream(spark, folder, versions=True), out, state, buckets=2).awaitTermination()
    assert evidence_store(out, 2).newest(spark) == before


def clue_rows(spark, n, owners=1, scheme=memory.SCHEME):
    rows = [(f"o{i % owners}", f"p{i:03d}", f"title {i % 7}", 1, i, ["seed"] if i % 2 else ["dropout", "seed"], {"seed": [i % 20, 99], "lr": []} if i % 3 else {}, scheme) for i in range(n)]
    df = spark.createDataFrame(rows, "owner string, fp string, title string, runs int, s int, unresolved array<string>, page_hints map<string,array<int>>, scheme int")
    return df.withColumn("last_seen", F.timestamp_seconds("s")).select("owner", *[c.split()[0] for c in MEMORY.split(", ")])


@pytest.mark.parametrize(("keep", "most"), [(5, 10**6), (10**6, 900)])
def test_keep_memory(spark, tmp_path, keep, most):
    """A memory that is full by number or by size folds its oldest; the result is that of the batch operators."""
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    clues = clue_rows(spark, 60, owners=3).persist()
    for part in ("s < 20", "s >= 20 and s < 21", "s >= 21"):
        clues.filter(part.replace("s ", "unix_seconds(last_seen) ").replace("s<", "unix_seconds(last_seen)<")).coalesce(1).write.mode("append").parquet(folder)
        keep_memory(spark.readStream.schema(clues.schema).parquet(folder), out, state, keep, most, buckets=4).awaitTermination()
    detail, digests = current_memory(spark, out, 4)
    kept, folded = memory.split_capacity(clues, keep, most, by=["owner"])
    assert 0 < kept.count() < 60
    plain = lambda df: sorted((r["owner"], r["fp"], r["title"], r["runs"], r["last_seen"], tuple(r["unresolved"]), tuple(sorted((k, tuple(v)) for k, v in r["page_hints"].items()))) for r in df.collect())
    assert plain(detail) == plain(kept)
    for o in range(3):
        mine = lambda df: sorted((r["key"], r["times"], tuple(r["pages"])) for r in df.collect())
        assert mine(digests.filter(f"owner = 'o{o}'")) == mine(memory.digest(folded.filter(f"owner = 'o{o}'")))


def test_keep_memory_of_repeated_papers(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    clues = clue_rows(spark, 3)
    old = clues.filter("fp = 'p001'").withColumn("last_seen", F.timestamp_seconds(F.lit(-5))).withColumn("title", F.lit("older"))
    for batch in (clues, clues.filter("fp <> 'p000'"), old, clues.limit(1).withColumn("scheme", F.lit(0)), clues.limit(1).withColumn("owner", F.lit(None).cast("string"))):
        batch.coalesce(1).write.mode("append").parquet(folder)
        keep_memory(spark.readStream.schema(clues.schema).parquet(folder), out, state, buckets=2).awaitTermination()
    detail, digests = current_memory(spark, out, 2)
    assert {r["fp"]: (r["runs"], r["title"]) for r in detail.collect()} == {"p000": (1, "title 0"), "p001": (3, "title 1"), "p002": (2, "title 2")}
    assert digests.count() == 0


def test_bucket_store(spark, tmp_path):
    store = BucketStore(f"file://{tmp_path}/t", "k string, v int, n int", ("k",), 16)
    rows = spark.createDataFrame([(f"k{i}" if i else None, i, 1) for i in range(400)], store.schema)
    assert store.read(spark).count() == 0 and len(store.upsert(rows, F.col("n"))) == 16
    assert store.upsert(rows, F.col("n")) == []  # a repeated run changes nothing
    reader = store.read(spark)  # opened before the next write
    some = spark.createDataFrame([("k7", 70, 2), ("k7", 71, 2), ("k8", 80, 0), ("new", 1, 1), (None, -1, 5)], store.schema)
    touched = store.upsert(some, F.col("n"))
    assert 0 < len(touched) <= 3 and set(touched) == {r[0] for r in some.filter("n > 0").select(store.bucket()).distinct().collect()}
    found = {r["k"]: r["v"] for r in store.read(spark).collect()}
    assert len(found) == 401 and (found["k7"], found["k8"], found["new"], found[None]) == (71, 8, 1, -1)
    assert {r["k"]: r["v"] for r in reader.collect()}["k7"] == 7  # the old state, whole
    assert store.replace(rows.limit(0), some.select("k")) and store.read(spark).count() == 397  # k7, k8, new and null went
    with pytest.raises(ValueError):
        BucketStore(store.path, store.schema, store.keys, 8).read(spark)


def test_bucket_store_failed_write_and_cleaning(spark, tmp_path):
    store = BucketStore(f"file://{tmp_path}/t", "k int, v int", ("k",), 4)
    write = lambda v: store.upsert(spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(v).alias("v")), F.col("v"))
    write(1)
    (tmp_path / "t/of=4/gen=000000000002/bucket=1").mkdir(parents=True)  # what a failed job leaves
    assert {r["v"] for r in store.read(spark).collect()} == {1}
    for v in range(2, 7):
        write(v)
    assert {r["v"] for r in store.read(spark).collect()} == {6} and store.read(spark).count() == 40
    assert len(store.generations(spark)) <= 3
    empty = store.replace(store.read(spark).limit(0), store.read(spark).select("k"))
    assert len(empty) == 4 and store.read(spark).count() == 0


def test_saved_memory(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    clues = clue_rows(spark, 30).drop("owner")
    assert memory.save(clues, path, 8) and memory.save(clues, path, 8) == []
    later = clues.filter("fp = 'p007'").withColumn("last_seen", F.timestamp_seconds(F.lit(999))).withColumn("title", F.lit("later"))
    assert len(memory.save(later, path, 8)) == 1
    found = {r["fp"]: (r["runs"], r["title"]) for r in memory.load(spark, path, 8).collect()}
    assert len(found) == 30 and found["p007"] == (2, "later") and found["p008"] == (1, "title 1")


def test_cache(spark, tmp_path):
    path, schema = f"file://{tmp_path}/cache", "key string, value string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert cached(spark, path, schema).count() == 0
    put_cache(rows(("a", "1"), ("b", "2")), path, schema)
    assert put_cache(rows(("a", "9")), path, schema) == [] and put_cache(rows(("c", "3")), path, schema)
    assert sorted(map(tuple, cached(spark, path, schema).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_prefix_sums(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), i, rng.choice([None, *range(9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    got = {(r["a"], r["b"]): (r["_n"], r["_sum"]) for r in generic.prefix_sums(df.repartition(7), [F.desc("a"), F.asc("b")], F.col("v"), parts=6).collect()}
    total, want = 0, {}
    for n, (a, b, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v or 0
        want[a, b] = (n, total)
    assert got == want
    assert generic.prefix_sums(df.limit(0), [F.col("a")], F.col("v")).count() == 0


@pytest.mark.parametrize(("keep", "most"), [(7, 10**6), (10**6, 1500), (5, 1)])
def test_one_large_store(spark, keep, most):
    """Number and size limits of one store agree with those of a store by owner, which is a plain window."""
    clues = clue_rows(spark, 50)
    for one, other in zip(memory.split_capacity(clues, keep, most), memory.split_capacity(clues, keep, most, by=["owner"]), strict=True):
        assert sorted(r["fp"] for r in one.collect()) == sorted(r["fp"] for r in other.collect())


def test_digest_with_one_before(spark):
    clues = clue_rows(spark, 40)
    old, new = clues.filter("fp < 'p020'"), clues.filter("fp >= 'p020'")
    rows = lambda df: sorted((r["key"], r["times"], tuple(r["pages"])) for r in df.collect())
    assert rows(memory.digest(new, memory.digest(old))) == rows(memory.digest(clues))
    assert rows(memory.digest(clues))[1:] == [("lr", 0, ()), ("seed", 40, tuple(range(12)))]


def test_html_tables(spark):
    html = "<table><tr><th>name</th><th>value</th></tr><tr><td></td><td> </td></tr><tr><td>lr</td><td>1e-4 <b>x</b></td></tr></table><table><tr><td>one row</td></tr></table>"
    rows = html_table_cells(spark.createDataFrame([(1, html)], "page_id bigint, html string")).collect()
    assert sorted((r["table_no"], r["row_no"], r["col_no"], r["cell"]) for r in rows) == [(0, 0, 0, "name"), (0, 0, 1, "value"), (0, 2, 0, "lr"), (0, 2, 1, "1e-4 x")]
