"""Pages and clues that keep arriving.

What a batch costs depends on the papers it touches, not on what came before in others' buckets: pages, evidence and memories lie in
buckets, of which a batch reads and rewrites those that hold its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract_paper import paper_evidence
from ..operators.memory import KEEP, MOST_CHARS, SCHEME
from ..schemas import EVIDENCE, MEMORY, PAPER_PAGES
from ..sinks.buckets import BUCKETS, BucketStore
from ..sinks.folders import at_rest
from .state import HELD, MEMORIES, PAGES, batch_mark, clue_rows, merge_memory, merge_pages, page_rows


def page_stream(spark: SparkSession, folder: str, versions: bool = False) -> DataFrame:
    return spark.readStream.schema(PAGES if versions else PAPER_PAGES).parquet(folder)


def evidence_store(path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(f"{path}/evidence", EVIDENCE, ("owner_id",), buckets)


def pages_store(path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(f"{path}/pages", HELD, ("paper_id",), buckets)


def memory_store(path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(f"{path}/memories", MEMORIES, ("owner",), buckets)


def watch(pages: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the evidence of all papers below ``store`` while pages arrive: it is decided anew over all pages of a paper, as which page
    is the first, which value fills a gap and which data set is meant depend on all of them. Evidence that a paper has no more goes.
    A batch that is repeated after a failure writes what it wrote before. ``then`` gets the new evidence and the batch's number."""

    # a batch is written where it is read by several jobs; the next one takes its place
    def one(batch: DataFrame, number: int) -> None:
        fresh, at, mark = at_rest(batch, f"{store}/batch"), pages_store(store, buckets), batch_mark(batch, number, checkpoint)
        touched = at.touched(fresh)
        if touched:
            at.rewrite(merge_pages(at.read(fresh.sparkSession, touched), fresh, mark), touched)
        arrived = at_rest(at.read(fresh.sparkSession, touched).filter(F.col("batch") == mark).drop("batch"), f"{store}/arrived")
        out = paper_evidence(arrived.select(*[c.split()[0] for c in PAPER_PAGES.split(", ")]))
        found = at_rest(out["evidence"], f"{store}/found")
        out["hits"].unpersist()
        evidence_store(store, buckets).replace(found, arrived.select(F.col("paper_id").alias("owner_id")))
        if then is not None:
            then(found, number)

    return page_rows(pages).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_evidence(spark: SparkSession, store: str, buckets: int = BUCKETS) -> DataFrame:
    """The evidence of every paper so far."""
    return evidence_store(store, buckets).read(spark)


def keep_memory(clues: DataFrame, store: str, checkpoint: str, keep: int = KEEP, most: int = MOST_CHARS, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the memories of all owners below ``store`` while clues (owner and the columns of MEMORY) arrive. A memory says which batch
    changed it last, so that a repeated batch changes nothing in it and runs are counted once."""

    def one(batch: DataFrame, number: int) -> None:
        fresh, at = at_rest(batch, f"{store}/clues"), memory_store(store, buckets)
        touched = at.touched(fresh)
        if touched:
            at.rewrite(merge_memory(at.read(fresh.sparkSession, touched), fresh, batch_mark(batch, number, checkpoint), keep, most), touched)

    return clue_rows(clues).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_memory(spark: SparkSession, store: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(entries in detail with the columns of MEMORY and owner, digests with owner, key, times and pages)."""
    rows = memory_store(store, buckets).read(spark).withColumn("scheme", F.lit(SCHEME))
    return rows.filter("kind = 'entry'").withColumnRenamed("name", "fp").select("owner", *[c.split()[0] for c in MEMORY.split(", ")]), rows.filter("kind = 'digest'").select("owner", F.col("name").alias("key"), "times", "pages")
