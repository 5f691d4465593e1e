"""Code sources: archives, folders and files as one table of texts, routed by extension."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import LANGUAGES
from ..functions import values as V
from ..schemas import CODE_FILES

CONFIG_NAME = r"(?i)(config|setting|param|train)"


def route(path: Column) -> Column:
    """What reads a file: py, ipynb, config, requirements, lang, or unsupported."""
    ext, name = V.extension(path), F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    return (
        F.when(ext == ".py", "py")
        .when(ext == ".ipynb", "ipynb")
        .when(ext.isin(".yaml", ".yml", ".json") & path.rlike(CONFIG_NAME), "config")
        .when(name.startswith("requirements") & (ext == ".txt"), "requirements")
        .when(ext.isin(*LANGUAGES), "lang")
        .otherwise("unsupported")
    )


def empty_files(spark: SparkSession) -> DataFrame:
    """What an absent or empty path gives: no rows, never the working folder."""
    return spark.createDataFrame([], CODE_FILES)


def files_from_text(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Files given as (code_id, path, text)."""
    df = spark.createDataFrame(rows, "code_id string, path string, text string") if rows else empty_files(spark)
    return df.select("code_id", "path", route(F.col("path")).alias("kind"), F.regexp_replace("text", "^﻿", "").alias("text"))


def read_folder(spark: SparkSession, path: str, code_id: str) -> DataFrame:
    """All files below a folder as whole texts."""
    if not path:
        return empty_files(spark)
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    files = raw.select(F.lit(code_id).alias("code_id"), F.regexp_replace("_metadata.file_path", r"^[a-z]+:/+", "/").alias("full"), F.col("value").alias("text"))
    base = path.split("://")[-1].rstrip("/")
    inside = F.substring("full", len(base) + 2, 4096)
    return files.select("code_id", inside.alias("path"), route(F.col("full")).alias("kind"), F.regexp_replace("text", "^﻿", "").alias("text"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for code_id, content in zip(pdf["code_id"], pdf["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            names = [n for n in archive.namelist() if not n.endswith("/")]
            tops = {n.split("/", 1)[0] for n in names}
            cut = 1 + len(next(iter(tops))) if len(tops) == 1 and all("/" in n for n in names) else 0
            for name in names:
                try:
                    rows.append((code_id, name[cut:], archive.read(name).decode("utf-8-sig", "replace")))
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
                    continue  # an entry that cannot be read is left out, as the rest of the archive is still evidence
        yield pd.DataFrame(rows, columns=["code_id", "path", "text"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files in the archives of a folder or glob; an archive's name is its code id, a single top folder is dropped."""
    if not path:
        return empty_files(spark)
    raw = spark.read.format("binaryFile").load(path)
    named = raw.select(F.regexp_extract("path", r"([^/\\]+?)(?:\.[^.]*)?$", 1).alias("code_id"), "content")
    files = named.mapInPandas(_members, "code_id string, path string, text string")
    return files.select("code_id", "path", route(F.col("path")).alias("kind"), "text")


def notebook_cells(files: DataFrame) -> DataFrame:
    """Code cells of notebooks with magics made harmless; cells that begin with %% are left out."""
    schema = "struct<cells:array<struct<cell_type:string,source:string>>>"
    books = files.filter("kind = 'ipynb'").select("code_id", "path", F.posexplode(F.from_json("text", schema)["cells"]).alias("cell", "c"))
    # a source is a string or a list of strings: the reader gives the latter as its JSON text
    listed = F.array_join(F.from_json("c.source", "array<string>"), "")
    source = F.when(F.col("c.source").startswith("["), F.coalesce(listed, F.col("c.source"))).otherwise(F.col("c.source"))
    cells = books.filter("c.cell_type = 'code'").select("code_id", "path", "cell", source.alias("source"))
    return cells.filter(~F.ltrim("source").startswith("%%")).select("code_id", "path", "cell", sanitize(F.col("source")).alias("text"))


def sanitize(source: Column) -> Column:
    """Lines of shell or magic commands become ``pass`` at their indent; an inline magic becomes None."""
    lines = F.transform(F.split(source, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\s*)[!%?].*$", "$1pass"), r"=\s*[!%].*$", "= None"))
    return F.array_join(lines, "\n")


def requirements(files: DataFrame) -> DataFrame:
    """(code_id, package, version) of requirement files; the version is empty where none is given."""
    lines = files.filter("kind = 'requirements'").select("code_id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("code_id", F.trim("line").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[#-]"))
    pattern = r"^([A-Za-z0-9_.\-]+)\s*(?:[=<>!~]=?\s*([0-9.]+))?"
    found = lines.select("code_id", F.lower(F.regexp_extract("line", pattern, 1)).alias("package"), F.regexp_extract("line", pattern, 2).alias("version"))
    return found.filter("package <> ''").distinct()


def code_lines(files: DataFrame) -> DataFrame:
    """(code_id, file, line, text): what a patch or a check of bounds looks up; no file is opened."""
    return files.select("code_id", F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n")).alias("_p", "text")).select("code_id", "file", (F.col("_p") + 1).alias("line"), "text")


def unsupported(files: DataFrame) -> DataFrame:
    """Files that nothing reads; they are listed, not dropped in silence."""
    return files.filter("kind = 'unsupported'").select("code_id", F.col("path").alias("file"))
