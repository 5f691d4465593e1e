"""The ladder of proposals under budgets: calls of each kind are counted by paper, and what was left out is told.

A missing parameter goes through the rungs in their order: numbers right beside its name, numbers tied to it from further off, places that say it is not
used (hints), an outside model, images. Parameters of a paper are served in the order of their keys; the model and the reading of images have so many
calls a paper, and a parameter that comes too late passes on to the next rung. Outside systems are ports: functions from the requests that may be made to
a table of what they gave.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.folders import at_rest, scratch
from .agent import gate, missing, negation_hints, scan_candidates
from .align import stable_readings

CANDIDATE = ["paper_id", "page_no", "key", "value", "evidence"]
#: From requests (paper_id, key) to candidates; from requests to READINGS of two runs each.
Propose = Callable[[DataFrame], DataFrame]
Read = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Budget:
    """Most calls a paper."""

    model: int = 3
    images: int = 2


def spend(requests: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(requests that may be made, requests that are left out) of (paper_id, key): the first ``most`` of each paper in the order of keys."""
    order = Window.partitionBy("paper_id").orderBy("key")
    ranked = requests.select("paper_id", "key").distinct().withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") <= most).drop("_r"), ranked.filter(F.col("_r") > most).drop("_r")


def _outcomes(asked: DataFrame, gated: DataFrame) -> DataFrame:
    """What became of each parameter that was asked for, with the first accepted candidate of it: no_hit without any, rejected if none was accepted."""
    first = F.min(F.when(F.col("ok"), F.struct("page_no", "evidence", "value"))).alias("c")
    told = gated.groupBy("paper_id", "key").agg(first, F.lit(True).alias("hit"))
    status = F.when(F.col("c").isNotNull(), "accepted").when(F.col("hit"), "rejected").otherwise("no_hit")
    return asked.join(told.hint("merge"), ["paper_id", "key"], "left").select("paper_id", "key", "c.page_no", "c.value", "c.evidence", status.alias("status"))


def image_candidates(readings: DataFrame, requests: DataFrame) -> DataFrame:
    """Values that both runs of a reading agree on, for the parameters that were asked for."""
    stable = stable_readings(readings).join(requests.hint("merge"), ["paper_id", "key"], "left_semi")
    return stable.select("paper_id", "page_no", "key", "value", F.col("evidence_text").alias("evidence"))


def fill_within(pages: DataFrame, mentioned: DataFrame, evidence: DataFrame, propose: Propose | None = None, read: Read | None = None, budget: Budget | None = None) -> dict[str, DataFrame]:
    """fills (with the rung that gave them), trace (one row for each rung that a parameter came to), ledger (calls by paper and kind, and what was left out),
    hints, and what stays unfilled. A port is called once, with all requests of all papers that have a call left; its answer is written down, so
    that no call is made twice."""
    budget = budget or Budget()
    at = scratch(pages.sparkSession, "ladder")
    open_ = at_rest(missing(mentioned, evidence).select("paper_id", "key").distinct(), f"{at}/gaps")
    scanned = at_rest(scan_candidates(pages, open_), f"{at}/scanned")
    hints = at_rest(negation_hints(pages, open_), f"{at}/hints")
    fills, traces, ledgers = [], [], []
    rungs = [
        ("text-l1", lambda asked: scanned.filter("level = 1"), None, True), ("text-l2", lambda asked: scanned.filter("level = 2"), None, True),
        ("negation", None, None, False), ("model", propose, budget.model, True), ("images", read and (lambda asked: image_candidates(at_rest(read(asked), f"{at}/readings"), asked)), budget.images, False),
    ]
    for number, (tool, give, most, grounded) in enumerate(rungs, 1):
        told = lambda df: df.select("paper_id", "key", F.lit(number).alias("attempt"), F.lit(tool).alias("tool"), "status")  # noqa: E731, B023
        if tool == "negation":
            hinted = hints.select("paper_id", "key", F.lit(True).alias("hinted")).distinct()
            traces.append(told(open_.join(hinted.hint("merge"), ["paper_id", "key"], "left").withColumn("status", F.when(F.col("hinted"), "hinted").otherwise("no_hit"))))
            continue
        if give is None:
            continue
        asked, late = (open_, None) if most is None else spend(open_, most)
        asked = asked if most is None else at_rest(asked, f"{at}/{tool}-asked")
        found = give(asked).select(*CANDIDATE)
        found = found if most is None else at_rest(found, f"{at}/{tool}-found")
        rows = _outcomes(asked, gate(found, pages) if grounded else found.withColumn("ok", F.lit(True)))
        if late is not None:
            rows = rows.unionByName(late.withColumn("status", F.lit("skipped")), allowMissingColumns=True)
        rows = at_rest(rows, f"{at}/{tool}")
        fills.append(rows.filter("status = 'accepted'").select(*CANDIDATE, F.lit(tool).alias("tool")))
        traces.append(told(rows))
        if most is not None:
            skipped = F.count_if(F.col("status") == "skipped")
            ledgers.append(rows.groupBy("paper_id").agg(F.lit(tool).alias("kind"), (F.count("*") - skipped).alias("calls"), F.lit(most).cast("long").alias("most"), skipped.alias("left_out")))
        open_ = rows.filter("status <> 'accepted'").select("paper_id", "key")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    none = pages.sparkSession.createDataFrame([], "paper_id string, kind string, calls bigint, most bigint, left_out bigint")
    return {"fills": union(fills), "trace": union(traces), "ledger": union([none, *ledgers]), "hints": hints, "unfilled": open_}
