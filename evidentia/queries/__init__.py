"""Registered queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, audits, kernels, ladders, layouts, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**align.QUERIES, **kernels.QUERIES, **audits.QUERIES, **stores.QUERIES, **layouts.QUERIES, **ladders.QUERIES}
ORACLES: dict[str, str] = {**align.ORACLES, **kernels.ORACLES, **audits.ORACLES, **stores.ORACLES, **layouts.ORACLES, **ladders.ORACLES}
ENTRY = QUERIES["align_orders_lineitem"]
