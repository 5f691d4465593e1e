"""The audit of many papers against many code bases as one set of lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import align as A
from ..operators.extract_code import code_evidence
from ..operators.extract_paper import mentioned_kinds, paper_evidence
from ..operators.score import readiness
from ..operators.verify import coverage, selfcheck
from ..sources.code import empty_files, requirements


def _of_audit(df: DataFrame, audits: DataFrame, owner: str) -> DataFrame:
    """Rows of an owner for every audit that uses it."""
    return df.join(audits.select("audit_id", F.col(owner).alias("owner_id")), "owner_id")


def audit(
    spark: SparkSession, audits: DataFrame, pages: DataFrame, files: DataFrame | None = None, *, cells: DataFrame | None = None, results: DataFrame | None = None, readings: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables of the audits: evidence, rejected, findings, readiness, coverage, failed files.

    audits: (audit_id, paper_id, code_id); pages: PAPER_PAGES; files: CODE_FILES; cells: TABLE_CELLS;
    results: RESULTS; readings: READINGS. What is not given is an empty table, and what it would have
    checked comes out as unverified.
    """
    files = files if files is not None else empty_files(spark)
    results = results if results is not None else spark.createDataFrame([], schemas.RESULTS)
    readings = readings if readings is not None else spark.createDataFrame([], schemas.READINGS)
    paper = paper_evidence(pages, cells)
    code_all, failed = code_evidence(files)
    # evidence has many readers below; it is kept so that no page or file is parsed again
    claims = _of_audit(paper["evidence"], audits, "paper_id").persist()
    code_all = _of_audit(code_all, audits, "code_id").persist()
    code = code_all.filter("reason is null")
    images = readings.join(audits.select("audit_id", "paper_id"), "paper_id")
    found = A.compare(claims, code).unionByName(A.align_results(_of_audit(paper["results"], audits, "paper_id"), results)).unionByName(A.align_images(images, claims, code))
    lengths = files.select(F.col("code_id"), F.col("path").alias("file"), F.size(F.split("text", r"\r?\n")).alias("n_lines")).join(audits.select("audit_id", "code_id"), "code_id").select("audit_id", "file", "n_lines")
    findings = A.ordered(selfcheck(found, lengths)).persist()
    rejected = _of_audit(paper["rejected"], audits, "paper_id").unionByName(code_all.filter("reason is not null").select("owner_id", "side", "key", F.col("raw_value").alias("value"), "location", "reason", "audit_id"))
    mentioned = mentioned_kinds(pages)
    return {
        "paper_evidence": claims,
        "code_evidence": code,
        "rejected": rejected,
        "failed_files": failed.join(audits.select("audit_id", "code_id"), "code_id"),
        "mentioned": mentioned,
        "findings": findings,
        "readiness": readiness(audits, findings, requirements(files), files, results),
        "coverage": coverage(audits, pages, mentioned, claims.select("owner_id", "key"), files.filter("kind <> 'unsupported'"), failed, findings, readings.select("paper_id", "page_no")),
    }
