"""Keyed state of streams as tables in buckets: the pages of each paper, and the memory of each owner.

A batch and what the buckets that it touches hold go by key through one shuffle and are merged by expressions: a key costs rows, no call of its own.
Rows bear the mark of the batch that changed their key last, which tells a batch that is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.memory import KEEP, MOST_CHARS, PAGES_PER_KEY, SCHEME, entry_size
from ..schemas import PAPER_PAGES

PAGES = f"{PAPER_PAGES}, version bigint"
#: Pages that are held, with the mark of the batch that changed their paper last.
HELD = f"{PAGES}, batch string"
#: Rows of memories: entries in detail, keys of digests. ``folded`` counts the entries of the owner that were folded, ``batch`` is the mark of what changed it last.
MEMORIES = "owner string, kind string, name string, title string, runs int, last_seen timestamp, unresolved array<string>, page_hints map<string,array<int>>, size int, times bigint, pages array<int>, folded bigint, batch string"


def batch_mark(batch: DataFrame, number: int, otherwise: str) -> str:
    """What tells a batch of a stream from all others; the same when the batch is repeated."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or otherwise}/{number}"


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with a version; those without a paper or a number are left out."""
    version = F.coalesce("version", F.lit(0)) if "version" in pages.columns else F.lit(0)
    held = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_images", F.lit(0)).cast("int").alias("n_images")
    return pages.filter("paper_id is not null and page_no is not null").select("paper_id", "page_no", *held, version.cast("bigint").alias("version"))


def merge_pages(now: DataFrame, fresh: DataFrame, mark: str) -> DataFrame:
    """Pages of papers (the columns of HELD) with fresh ones (of ``page_rows``) in them. All pages of a paper that gets a new or changed page
    bear ``mark``, those of one that gets what it has do not; a paper that bears it already keeps it, so that a repeated batch gives what it gave.

    Of a page that comes more than once that with the greatest (version, text, images) stays: what is held does not depend on
    the order of arrival nor on how it is cut into batches. Rows are shuffled once, by paper."""
    rows = now.withColumn("_old", F.lit(True)).unionByName(fresh.withColumn("_old", F.lit(False)), allowMissingColumns=True).repartition("paper_id")
    order = Window.partitionBy("paper_id", "page_no").orderBy(F.desc("version"), F.desc("text"), F.desc("n_images"), F.desc("_old"))
    page = Window.partitionBy("paper_id", "page_no")
    ranked = rows.withColumns({"_r": F.row_number().over(order), "_was": F.max("batch").over(page)}).filter("_r = 1")
    # a fresh row that equals what is held stands behind it and changes nothing
    paper = Window.partitionBy("paper_id")
    ranked = ranked.withColumns({"_changed": F.max(~F.col("_old")).over(paper), "_mark": F.max("_was").over(paper)})
    return ranked.select("paper_id", "page_no", "text", "n_images", "version", F.when(F.col("_changed"), mark).otherwise(F.col("_mark")).alias("batch"))


def clue_rows(clues: DataFrame) -> DataFrame:
    """Clues (owner and the columns of MEMORY) as entries of memories; those of another scheme and those without an owner or a fingerprint
    are left out."""
    rows = clues.filter(f"scheme = {SCHEME} and owner is not null and fp is not null")
    return rows.select("owner", F.col("fp").alias("name"), "title", "runs", F.coalesce("last_seen", F.timestamp_seconds(F.lit(0))).alias("last_seen"), "unresolved", "page_hints")


def merge_memory(now: DataFrame, fresh: DataFrame, mark: str, keep: int = KEEP, most: int = MOST_CHARS) -> DataFrame:
    """Memories (the columns of MEMORIES) with fresh entries (of ``clue_rows``) in them: at most ``keep`` entries and ``most`` characters of an
    owner in detail, a digest of what was folded. Memories that ``mark`` has changed before stay as they are.

    An entry of a fingerprint that is there takes its place and adds to its runs, unless it is older: then it only adds to them. When
    the memory is full the oldest entries are folded: their open keys are counted, and at most twelve pages of each key stay.
    Rows are shuffled once, by owner; no more than twelve pages of a key are held together."""
    payload = ("title", "last_seen", "unresolved", "page_hints", "size")
    arrived = fresh.withColumns({"kind": F.lit("entry"), "_old": F.lit(False)})
    rows = now.withColumn("_old", F.lit(True)).unionByName(arrived, allowMissingColumns=True).repartition("owner")
    mine = Window.partitionBy("owner")
    done = F.max(F.coalesce(F.col("batch") == mark, F.lit(False))).over(mine)
    rows = rows.withColumns({"_done": done, "_folded": F.coalesce(F.max("folded").over(mine), F.lit(0)), "_touched": F.max(~F.col("_old")).over(mine), "_batch": F.max("batch").over(mine)})
    rows = rows.filter("_old or not _done").withColumn("_batch", F.when(F.col("_touched"), mark).otherwise(F.col("_batch")))
    # a batch may lie in one file, that one task reads: what is made of its rows is made behind the shuffle
    rows = rows.withColumn("size", F.coalesce("size", entry_size(F.col("name").alias("fp")))).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))
    newest = F.struct("last_seen", F.coalesce("title", F.lit("")).alias("t"), F.array_sort("unresolved").alias("u"), (~F.col("_old")).alias("new"), F.to_json("page_hints").alias("h"))
    merged = rows.groupBy("owner", "kind", "name", "_batch", "_folded").agg(
        F.sum("runs").cast("int").alias("runs"), F.max_by(F.struct(*payload), newest).alias("e"), F.max("times").alias("times"), F.max("pages").alias("pages")
    ).select("owner", "kind", "name", "_batch", "_folded", "runs", "times", "pages", "e.*")
    order = Window.partitionBy("owner", "kind").orderBy(F.desc("last_seen"), F.asc("name"))
    n, total = F.row_number().over(order), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    entry = F.col("kind") == "entry"
    sized = merged.withColumns({"_n": n, "_sum": total}).withColumn("_fits", entry & (F.col("_n") <= keep) & ((F.col("_sum") <= most) | (F.col("_n") == 1)))
    sized = sized.withColumn("_folded", F.col("_folded") + F.count(F.when(entry & ~F.col("_fits"), 1)).over(mine))
    told = f"kind string, name string, times bigint, page int, e struct<runs:int,{','.join(f'{c}:{t}' for c, t in (x.split() for x in MEMORIES.split(', ')) if c in payload)}>"
    row = lambda kind, name, times, page, e: F.struct(kind.alias("kind"), name.alias("name"), times.cast("bigint").alias("times"), page.cast("int").alias("page"), e.alias("e"))
    null, digest, once, none = F.lit(None), F.lit("digest"), F.lit(1), F.lit(0)
    no_entry = null.cast(told.split(", e ")[1])
    with_pages = lambda k, pages: F.transform(F.coalesce(pages, F.array()), lambda p: row(digest, k, none, p, no_entry))
    # what a row gives: itself if it stays, its open keys and the pages of its hints if it is folded, its count and its pages if it is of a digest
    kept = F.array(row(F.col("kind"), F.col("name"), none, null, F.struct("runs", *payload)))
    open_ = F.transform("unresolved", lambda k: row(digest, k, once, null, no_entry))
    hints = F.flatten(F.transform(F.coalesce(F.map_entries("page_hints"), F.array()), lambda h: F.concat(F.array(row(digest, h["key"], none, null, no_entry)), with_pages(h["key"], h["value"]))))
    before = F.concat(F.array(row(digest, F.col("name"), F.col("times"), null, no_entry)), with_pages(F.col("name"), F.col("pages")))
    gives = F.when(F.col("_fits"), kept).when(entry, F.concat(open_, hints)).otherwise(before)
    given = sized.select("owner", F.col("_batch").alias("batch"), F.col("_folded").alias("folded"), F.inline(gives))
    key = ("owner", "kind", "name", "batch", "folded")
    pages = given.groupBy(*key, "page").agg(F.sum("times").alias("times"), F.first("e", ignorenulls=True).alias("e"))
    first = F.count("page").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("page")).rowsBetween(Window.unboundedPreceding, 0)) <= PAGES_PER_KEY
    few = pages.withColumn("_first", first).groupBy(*key).agg(F.sum("times").alias("times"), F.array_sort(F.collect_list(F.when(F.col("_first"), F.col("page")))).alias("pages"), F.first("e", ignorenulls=True).alias("e"))
    return few.select(*[F.col(f"e.{c}").alias(c) if c in (*payload, "runs") else F.col(c) for c in (x.split()[0] for x in MEMORIES.split(", "))])
