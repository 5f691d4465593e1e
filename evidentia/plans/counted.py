"""Tables of an audit written with counts that are taken in passing: no table is read a second time for its figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..dims import RISK_ORDER
from ..operators.extract_paper import numeric_guards, text_guards

OTHER = "(other)"
#: The column whose values each table is counted by.
BY = {"paper_evidence": "channel", "code_evidence": "channel", "rejected": "reason", "findings": "risk", "failed_files": None, "readiness": None, "coverage": None, "mentioned": None}
CHANNELS = ("text", "table", "ast", "config", "regex", "vision")


def reasons() -> list[str]:
    """All reasons that a guard of the paper side gives, each once, in order."""
    return list(dict.fromkeys(label for label, _ in [*numeric_guards(), *text_guards()]))


def write_counted(df: DataFrame, path: str, column: str | None = None, values: Sequence[str] = ()) -> dict[str | None, int]:
    """Write a table and count its rows meanwhile: in all (None), by each of ``values`` of ``column``, and the rest (``OTHER``)."""
    seen = Observation()
    by = [F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)] if column else []
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *by).write.mode("overwrite").parquet(path)
    got = seen.get
    counts = {v: got[f"_{i}"] for i, v in enumerate(values)} if column else {}
    return {None: got["rows"], **{v: n for v, n in counts.items() if n}, **({OTHER: rest} if column and (rest := got["rows"] - sum(counts.values())) else {})}


def write_audit(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables of an audit below ``path``: (table, value, n), with null for all rows of a table."""
    values = {"channel": CHANNELS, "reason": reasons(), "risk": tuple(RISK_ORDER)}
    rows = [(name, value, n) for name, column in BY.items() if name in tables for value, n in write_counted(tables[name], f"{path}/{name}", column, values.get(column, ())).items()]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, value string, n bigint")
