"""Streams with keyed state, keyed tables in buckets and stores of any size, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generic, memory
from ..schemas import PAPER_PAGES
from ..sinks.buckets import BucketStore
from ..sinks.folders import at_rest, scratch
from ..streaming.incremental import current_evidence, current_memory, keep_memory, page_stream, watch
from .align import table
from .audits import _pages, _parts, _text

#: Characters that a store of orders may hold, and users' events that their memory may hold.
MOST, KEEP = 60_000, 4


def one_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as entries of one store: the place and the running size of each, the newest first, and whether it stays in detail."""
    orders = table(spark, sf_dir, "orders")
    entries = orders.select(
        _text("o", F.col("o_orderkey")).alias("fp"), _text("c", F.col("o_custkey")).alias("title"), F.lit(1).alias("runs"), F.col("o_orderdate").cast("timestamp").alias("last_seen"),
        F.array("o_orderpriority").alias("unresolved"), F.create_map("o_orderpriority", F.array(F.month("o_orderdate"))).alias("page_hints"), F.lit(memory.SCHEME).alias("scheme"),
    )
    kept, _ = memory.split_capacity(entries, keep=10**9, most=MOST)
    places = generic.prefix_sums(entries, [F.desc("last_seen"), F.asc("fp")], memory.entry_size())
    return places.join(kept.select("fp", F.lit(True).alias("kept")), "fp", "left").select("fp", F.col("_n").alias("place"), F.col("_sum").alias("chars"), F.coalesce("kept", F.lit(False)).alias("kept"))


def one_store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of the line items of a store that holds the 1,000 newest: how often each kind was folded and at most twelve days of the month."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(
        _text(*[x for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") for x in (F.col(c), "-")]).alias("fp"), F.lit("t").alias("title"), F.lit(1).alias("runs"), F.col("l_shipdate").cast("timestamp").alias("last_seen"),
        F.array("l_returnflag", "l_linestatus").alias("unresolved"), F.create_map("l_returnflag", F.array(F.dayofmonth("l_shipdate"))).alias("page_hints"), F.lit(memory.SCHEME).alias("scheme"),
    )
    _, folded = memory.split_capacity(entries, keep=1000, most=10**15)
    return memory.digest(folded).select("key", "times", F.array_join("pages", ",").alias("pages"))


def streamed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clues of their users that arrive in three batches: what each memory holds in detail, and its digest."""
    events = table(spark, sf_dir, "events").filter("user_id is not null")
    clues = events.select(
        F.col("user_id").cast("string").alias("owner"), _text("e", F.col("event_id")).alias("fp"), F.lit("t").alias("title"), F.lit(1).alias("runs"), F.col("ts").alias("last_seen"),
        F.array("event_type").alias("unresolved"), F.create_map("event_type", F.array(F.hour("ts"))).alias("page_hints"), F.lit(memory.SCHEME).alias("scheme"),
    )
    at = scratch(spark, "streamed-memory")
    clues = at_rest(clues.repartition(3, "fp"), f"{at}/in")
    stream = spark.readStream.schema(clues.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    keep_memory(stream, f"{at}/out", f"{at}/state", keep=KEEP).awaitTermination()
    detail, digests = current_memory(spark, f"{at}/out")
    shown = detail.select("owner", F.lit("entry").alias("kind"), F.col("fp").alias("name"), F.lit(0).cast("long").alias("times"), F.lit("").alias("pages"))
    return shown.unionByName(digests.select("owner", F.lit("digest").alias("kind"), F.col("key").alias("name"), "times", F.array_join("pages", ",").alias("pages")))


def streamed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of each part's paper that arrive apart, the second first, then a page with another batch size for every seventh paper: the evidence of all pages."""
    parts, n = _parts(spark, sf_dir), F.col("n")
    first = _text("All models are trained for ", n + 1, " epochs.")
    second = _text("We use a batch size of ", n, " here.")
    third = _text("We use a batch size of ", n + 500, " here.")
    at = scratch(spark, "streamed-evidence")
    pages = _pages(parts, first, second)
    other = _pages(parts.filter("k % 7 = 0"), F.lit(None).cast("string"), F.lit(None).cast("string"), third).filter("page_no = 3")
    for k, batch in enumerate((pages.filter("page_no = 2"), pages.filter("page_no = 1"), other)):
        batch.select(*[c.split()[0] for c in PAPER_PAGES.split(", ")]).coalesce(1).write.parquet(f"{at}/in/{k}")
        watch(page_stream(spark, f"{at}/in/*"), f"{at}/out", f"{at}/state").awaitTermination()
    return current_evidence(spark, f"{at}/out").select("owner_id", "key", "raw_value", "num", "page", "location")


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer in a keyed table that two writes made: all orders, then the urgent ones once more."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("bigint").alias("o"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"))
    store = BucketStore(f"{scratch(spark, 'newest-orders')}/t", "customer string, o bigint, day date, priority string", ("customer",), 16)
    newest = F.struct("day", "o")
    store.upsert(orders.filter("o % 2 = 0"), newest)
    store.upsert(orders.filter("o % 2 = 1 or priority = '1-URGENT'"), newest)
    return store.read(spark)


QUERIES = {f.__name__: f for f in (one_store, one_store_digest, streamed_memory, streamed_evidence, newest_orders)}

ORACLES = {
    "one_store": f"""
WITH e AS (SELECT 'o' || o_orderkey AS fp, o_orderdate AS d, length('{{"fp":"o' || o_orderkey || '","title":"c' || o_custkey || '","unresolved":["' || o_orderpriority || '"],"page_hints":{{"' || o_orderpriority || '":[' || month(o_orderdate) || ']}}}}') AS size FROM orders),
s AS (SELECT fp, row_number() OVER w AS place, cast(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS bigint) AS chars FROM e WINDOW w AS (ORDER BY d DESC, fp))
SELECT fp, place, chars, chars <= {MOST} OR place = 1 AS kept FROM s""",
    "one_store_digest": """
WITH r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-') AS rn FROM lineitem),
f AS (SELECT * FROM r WHERE rn > 1000),
t AS (SELECT key, count(*) AS times FROM (SELECT l_returnflag AS key FROM f UNION ALL SELECT l_linestatus FROM f) GROUP BY 1),
p AS (SELECT l_returnflag AS key, list_slice(list_sort(list_distinct(list(day(l_shipdate)))), 1, 12) AS pages FROM f GROUP BY 1)
SELECT key, times, coalesce(array_to_string(pages, ','), '') AS pages FROM t LEFT JOIN p USING (key)""",
    "streamed_memory": f"""
WITH r AS (SELECT cast(user_id AS varchar) AS owner, 'e' || event_id AS name, event_type AS key, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'e' || event_id) AS rn FROM events WHERE user_id IS NOT NULL)
SELECT owner, 'entry' AS kind, name, 0::BIGINT AS times, '' AS pages FROM r WHERE rn <= {KEEP}
UNION ALL SELECT owner, 'digest', key, count(*), array_to_string(list_slice(list_sort(list_distinct(list(h))), 1, 12), ',') FROM r WHERE rn > {KEEP} GROUP BY owner, key""",
    "streamed_evidence": """
WITH p AS (SELECT 'p' || p_partkey AS owner_id, p_partkey AS k, p_size AS n FROM part)
SELECT owner_id, 'epochs' AS key, cast(n + 1 AS varchar) AS raw_value, cast(n + 1 AS double) AS num, 1 AS page, 'Page 1' AS location FROM p
UNION ALL SELECT owner_id, 'batch_size', cast(n AS varchar), n, 2, 'Page 2' FROM p
UNION ALL SELECT owner_id, 'batch_size', cast(n + 500 AS varchar), n + 500, 3, 'Page 3' FROM p WHERE k % 7 = 0""",
    "newest_orders": """
SELECT cast(o_custkey AS varchar) AS customer, cast(o_orderkey AS bigint) AS o, cast(o_orderdate AS date) AS day, o_orderpriority AS priority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
}
