"""Paper sources: page texts, table cells of HTML, readings, results. Decoders of binary formats are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sinks.buckets import BUCKETS, BucketStore


def pages_from_text(spark: SparkSession, papers: dict[str, list[str]]) -> DataFrame:
    rows = [(p, i, text, 0) for p, pages in papers.items() for i, text in enumerate(pages, 1)]
    return spark.createDataFrame(rows, "paper_id string, page_no int, text string, n_images int")


def decoded_pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[tuple[str, int]]]) -> DataFrame:
    """Pages of binary files by a decoder that gives (text, number of images) for each page; a file that it cannot read gives none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for paper, content in zip(pdf["paper_id"], pdf["content"], strict=True):
                try:
                    found = decode(content)
                except Exception:  # noqa: BLE001  a decoder may fail in any way on a foreign file
                    continue
                rows += [(paper, i, text, images) for i, (text, images) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["paper_id", "page_no", "text", "n_images"]).astype({"page_no": "int32", "n_images": "int32"})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/\\]+?)(?:\.[^.]*)?$", 1).alias("paper_id"), "content")
    return files.mapInPandas(read, "paper_id string, page_no int, text string, n_images int")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/\\]+?)(?:\.[^.]*)?$", 1).alias("paper_id"), V.fingerprint(F.col("content")).alias("fp"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("paper_id").agg(F.count("*").alias("pages"))


def html_table_cells(pages: DataFrame) -> DataFrame:
    """Cells of HTML tables (page_id, html): rows without text go, and tables of fewer than two rows."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = rows.select("page_id", "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col_no", "c"))
    plain = cells.withColumn("cell", V.collapse_space(F.regexp_replace("c", "<[^>]*>", " "))).drop("c")
    some = plain.groupBy("page_id", "table_no", "row_no").agg(F.bool_or(F.col("cell") != "").alias("any")).filter("any")
    enough = some.groupBy("page_id", "table_no").agg(F.count("*").alias("n")).filter("n >= 2")
    return plain.join(some.drop("any"), ["page_id", "table_no", "row_no"], "left_semi").join(enough, ["page_id", "table_no"], "left_semi")


def image_regions(pages: DataFrame, images: DataFrame, most: int = 120, least_share: float = 0.2) -> DataFrame:
    """Regions worth reading: thin pages as wholes, else images of at least a fifth of the page, those on pages with parameter
    words first. ``images``: paper_id, page_no, image_no, share. The cap is the budget of readings of a paper."""
    from pyspark.sql.window import Window

    words = r"(?i)learning rate|batch|epoch|optimizer|dropout|weight decay|hyper-?parameter|学习率|批|迭代|优化器|超参|参数"
    page = pages.select("paper_id", "page_no", V.is_thin(F.coalesce("text", F.lit(""))).alias("thin"), F.coalesce("text", F.lit("")).rlike(words).alias("hint"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    whole = page.filter("thin").select("paper_id", "page_no", F.lit("page").alias("region_kind"), F.lit(0).alias("image_no"), "hint", "chars")
    part = images.filter(F.col("share") >= least_share).join(page.filter("not thin and hint"), ["paper_id", "page_no"]).select("paper_id", "page_no", F.lit("image").alias("region_kind"), "image_no", "hint", "chars")
    w = Window.partitionBy("paper_id").orderBy(F.desc("hint"), F.desc("chars"), "page_no", "image_no")
    return whole.unionByName(part).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(audit_id, metric, value) of JSON objects of numbers; a file's name is its audit."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/\\]+?)(?:\.[^.]*)?$", 1).alias("audit_id"), F.from_json("value", "map<string,double>").alias("m"))
    return raw.select("audit_id", F.explode("m").alias("metric", "value")).filter("value is not null")


def cached(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("key",), buckets: int = BUCKETS) -> DataFrame:
    """A keyed cache; one that is not there yet is empty."""
    return BucketStore(path, schema, keys, buckets).read(spark)


def put_cache(rows: DataFrame, path: str, schema: str, keys: tuple[str, ...] = ("key",), newest: Column | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put rows into a keyed cache, which holds one a key: the newest, or without ``newest`` the first that came. Only buckets of new keys are
    rewritten, each without what it had before, so that the cache does not grow by what is repeated."""
    return BucketStore(path, schema, keys, buckets).upsert(rows, F.lit(0) if newest is None else newest)


def purge(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """Remove run state below the given paths: (path, bytes removed) as a receipt."""
    jvm, conf, receipt = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        if fs.exists(target):
            size = fs.getContentSummary(target).getLength()
            fs.delete(target, True)
            receipt.append((path, int(size)))
    return receipt
