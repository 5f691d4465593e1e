"""What is remembered of earlier audits: clues of each paper, never values, and a digest of what was folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import MEMORY
from ..sinks.buckets import BUCKETS, BucketStore
from .generic import prefix_sums

SCHEME = 1
KEEP, MOST_CHARS, PAGES_PER_KEY = 40, 24_000, 12


def current(store: DataFrame) -> DataFrame:
    """Entries of this scheme; those of another are as if they were not there."""
    return store.filter(F.col("scheme") == SCHEME)


def remember(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by fingerprint: the newest clues win, the runs add up. Both tables have the columns of MEMORY."""
    every = current(store).unionByName(fresh)
    newest = F.struct("last_seen", "title", F.array_sort("unresolved").alias("u"))
    runs = every.groupBy("fp").agg(F.sum("runs").cast("int").alias("runs"))
    last = every.groupBy("fp").agg(F.max_by(F.struct("title", "last_seen", "unresolved", "page_hints"), newest).alias("m"))
    return last.join(runs, "fp").select("fp", "m.title", "runs", "m.last_seen", "m.unresolved", "m.page_hints", F.lit(SCHEME).alias("scheme"))


def entry_size(fp: Column | str = "fp") -> Column:
    return F.length(F.to_json(F.struct(fp, "title", "unresolved", "page_hints")))


def save(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Put the clues of finished audits into the store at ``path``; gives the buckets that were rewritten. An audit is known by its
    fingerprint and time: one that is not newer than what is stored was counted before, so that a repeated run changes nothing."""
    return BucketStore(path, MEMORY, ("fp",), buckets).upsert(current(fresh), F.col("last_seen"), remember)


def load(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return current(BucketStore(path, MEMORY, ("fp",), buckets).read(spark))


def split_capacity(store: DataFrame, keep: int = KEEP, most: int = MOST_CHARS, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept in detail, to be folded): the newest, up to a number and a sum of sizes, of each store; ``by`` names the columns
    that tell whose store an entry is of. Without them the table is one store of any size, in ranges of time."""
    newest = [F.desc("last_seen"), F.asc("fp")]
    if by:
        order = Window.partitionBy(*by).orderBy(*newest)
        sized = store.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum(entry_size()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        sized = prefix_sums(store, newest, entry_size())
    fits = (F.col("_n") <= keep) & ((F.col("_sum") <= most) | (F.col("_n") == 1))
    return sized.filter(fits).drop("_n", "_sum"), sized.filter(~fits).drop("_n", "_sum")


def _first_pages(pages: DataFrame) -> DataFrame:
    """(key, pages): of (key, page) the first twelve of each key; no more of a key are ever held together."""
    order = Window.partitionBy("key").orderBy("page")
    few = pages.distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= PAGES_PER_KEY)
    return few.groupBy("key").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def digest(folded: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, papers, times, pages): how often a key stayed unresolved, and at most twelve pages where it was found."""
    none = F.array().cast("array<int>")
    times = folded.select(F.explode("unresolved").alias("key"), F.lit(1).cast("long").alias("times"))
    pages = folded.select(F.explode("page_hints").alias("key", "p")).select("key", F.explode_outer("p").alias("page"))
    if before is not None:
        times = times.unionByName(before.select("key", "times"))
        pages = pages.unionByName(before.select("key", F.explode("pages").alias("page")))
    # a key that has hints without a page, or none, is told as well
    keys = times.groupBy("key").agg(F.sum("times").alias("times")).join(pages.groupBy("key").agg(F.count("*").alias("_")), "key", "full_outer")
    return keys.join(_first_pages(pages.filter("page is not null")), "key", "left").select("key", F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.coalesce("pages", none).alias("pages"))


def recall(store: DataFrame, prints: DataFrame) -> DataFrame:
    return current(store).join(prints.select("fp").distinct(), "fp", "left_semi")


def hint_lines(entries: DataFrame) -> DataFrame:
    line = F.format_string("第 %d 次审计: 上次未取到 %s", F.col("runs") + 1, F.array_join("unresolved", ", "))
    return entries.select("fp", line.alias("line"))


def digest_lines(folded: DataFrame) -> DataFrame:
    """What a digest says of each key, for a reader."""
    line = F.concat("key", F.lit(": 在较早的审计中 "), "times", F.lit(" 次未取到"), F.when(F.size("pages") > 0, F.concat(F.lit(", 曾见于第 "), F.array_join("pages", ", "), F.lit(" 页"))).otherwise(""))
    return folded.select("key", line.alias("line"))


def unresolved_statistics(live: DataFrame, folded: DataFrame, k: int = 6) -> DataFrame:
    """The keys that most often stay unresolved, over detail and digest."""
    now = live.select(F.explode("unresolved").alias("key")).groupBy("key").agg(F.count("*").alias("times"))
    return now.unionByName(folded.select("key", "times")).groupBy("key").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "key").limit(k)


def capacity(live: DataFrame, folded_papers: int = 0) -> DataFrame:
    return live.agg(F.count("*").alias("detail"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("chars")).withColumn("digested", F.lit(folded_papers)).withColumn("most", F.lit(KEEP))


def clues(findings: DataFrame, evidence: DataFrame, missing: DataFrame, audits: DataFrame) -> DataFrame:
    """Fresh memory rows of finished audits: fingerprint, what stayed open, and pages by key. ``audits`` has paper_id, fp,
    title and seen; values are not among the columns."""
    open_ = missing.groupBy("paper_id").agg(F.array_sort(F.collect_set("key")).alias("unresolved"))
    pages = evidence.groupBy(F.col("owner_id").alias("paper_id"), "key").agg(F.slice(F.array_sort(F.collect_set("page")), 1, PAGES_PER_KEY).alias("p"))
    hints = pages.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "p")))).alias("page_hints"))
    rows = audits.join(open_, "paper_id", "left").join(hints, "paper_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("fp", "title", F.lit(1).alias("runs"), F.col("seen").alias("last_seen"), F.coalesce("unresolved", none).alias("unresolved"), F.coalesce("page_hints", F.create_map().cast("map<string,array<int>>")).alias("page_hints"), F.lit(SCHEME).alias("scheme"))
