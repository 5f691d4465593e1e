"""An audit from the command line: ``python -m evidentia.cli PAGES CODE [RESULTS] [--out FOLDER]``.

PAGES is a JSON file with a list of page texts, CODE a folder of source files, RESULTS a JSON object of metrics.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from . import schemas
from .operators.explain import explain
from .operators.trace import traces
from .plans.audit import audit
from .sinks.report import markdown
from .sources.code import files_from_text
from .sources.paper import pages_from_text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pages", type=Path)
    parser.add_argument("code", type=Path)
    parser.add_argument("results", type=Path, nargs="?")
    parser.add_argument("--out", type=Path)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    pages = pages_from_text(spark, {"paper": json.loads(given.pages.read_text(encoding="utf-8"))})
    files = files_from_text(spark, [("code", str(f.relative_to(given.code)), f.read_text(encoding="utf-8", errors="replace")) for f in sorted(given.code.rglob("*")) if f.is_file()])
    measured = json.loads(given.results.read_text(encoding="utf-8")) if given.results else {}
    results = spark.createDataFrame([("audit", k, float(v)) for k, v in measured.items()], schemas.RESULTS)
    tables = audit(spark, spark.createDataFrame([("audit", "paper", "code")], schemas.AUDITS), pages, files, results=results)
    tables["traces"] = traces(tables["findings"], tables["code_evidence"])
    for r in tables["readiness"].orderBy("category").collect():
        print(f"{r['category']:<8} {'-' if r['score'] is None else r['score']} {r['unverified_reason']}")
    for r in tables["findings"].orderBy("seq").select("display", "status", "risk", "paper.raw_value", "paper.location", "code.raw_value", "code.location").collect():
        print(f"{r[0]}: {r[1]} ({r[2]})\n  paper {r[3] or '-'} @ {r[4] or '-'}\n  code  {r[5] or '-'} @ {r[6] or '-'}")
    for r in explain(tables["findings"])[0].orderBy("seq").collect():
        print(f"{r['key']}: {r['explanation']}")
    report = markdown(tables).first()
    if given.out and report:
        given.out.mkdir(parents=True, exist_ok=True)
        (given.out / "report.md").write_text(report["report"], encoding="utf-8")
    for name in ("paper_evidence", "code_evidence", "findings"):
        tables[name].unpersist()


if __name__ == "__main__":
    main()
