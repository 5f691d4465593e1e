"""Which steps an audit runs: a registry with needs and products, a rule plan, outside proposals with vetoes, a run log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    core: bool = False


#: The extension point: a step is its name, what it needs and what it gives.
STEPS = (
    Step("parse_paper", (), ("paper",), True),
    Step("read_images", ("paper",), ("images",)),
    Step("fill_missing", ("paper",), ("fills",)),
    Step("analyze_code", (), ("code",)),
    Step("align", ("paper", "code"), ("findings",), True),
    Step("explain", ("findings",), ("explanations",)),
    Step("selfcheck", ("findings",), ("checks",), True),
    Step("trace", ("code", "findings"), ("traces",)),
    Step("patch", ("traces",), ("patches",)),
    Step("report", ("findings",), ("report",), True),
)


@dataclass
class Decision:
    step: str
    run: bool
    reason: str
    source: str = "rule"


@dataclass
class Plan:
    decisions: list[Decision]
    notes: list[str] = field(default_factory=list)

    def runs(self, step: str) -> bool:
        return next(d.run for d in self.decisions if d.step == step)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.step, d.run, d.reason, d.source) for d in self.decisions], "step string, run boolean, reason string, source string")


def rule_plan(*, pages: int, has_code: bool, can_read_images: bool, classic: bool = False, steps: Iterable[Step] = STEPS) -> Plan:
    """Every step, or without those that have no material."""
    out = []
    for s in steps:
        reason = ""
        if not classic:
            if s.name in ("analyze_code", "trace", "patch") and not has_code:
                reason = "未提供代码"
            elif s.name == "read_images" and (not can_read_images or pages <= 2):
                reason = "无读图能力" if not can_read_images else "页数过少"
        out.append(Decision(s.name, not reason, reason or "默认执行"))
    return Plan(out)


def agent_seconds(pages: int) -> int:
    """Time that filling gaps may take, by the length of a paper."""
    return 30 if pages <= 8 else 45 if pages <= 40 else 90


def refine(plan: Plan, proposals: list[dict], steps: tuple[Step, ...] = STEPS) -> Plan:
    """Take proposals to skip steps. A core step, an unknown one and a proposal without a reason are vetoed. A step goes too
    once every producer of something it needs is skipped; this repeats until nothing changes."""
    known = {s.name: s for s in steps}
    out = {d.step: Decision(d.step, d.run, d.reason, d.source) for d in plan.decisions}
    notes = list(plan.notes)
    for p in proposals:
        name, reason = str(p.get("tool", "")), str(p.get("reason") or "").strip()
        if p.get("action") != "skip" or name not in known or not out[name].run:
            if name not in known:
                notes.append(f"未知步骤 {name} 的提议已忽略")
            continue
        if known[name].core or not reason:
            out[name] = Decision(name, True, "核心步骤不可跳过" if known[name].core else "提议未给理由", "veto")
        else:
            out[name] = Decision(name, False, reason, "llm")
    changed = True
    while changed:
        changed = False
        for s in steps:
            lost = [n for n in s.needs if not any(out[x.name].run for x in steps if n in x.gives)]
            if out[s.name].run and lost and not s.core:
                out[s.name] = Decision(s.name, False, f"所需产物 {lost[0]} 的生产步骤均已跳过", "cascade")
                changed = True
    return Plan([out[s.name] for s in steps], notes)


def totals(plan: Plan) -> dict[str, int]:
    """How many steps of a plan run and how many are skipped."""
    ran = sum(d.run for d in plan.decisions)
    return {"ran": ran, "skipped": len(plan.decisions) - ran}


def run_steps(spark: SparkSession, plan: Plan, build: dict[str, Callable[[], object]], blank: dict[str, str] | None = None) -> tuple[dict[str, object], DataFrame]:
    """Call the builders of the steps that run, in the order of the plan; a failure is logged and raised. A skipped step leaves
    an empty table of its schema in ``blank``, so that what comes after reads it as a step that found nothing."""
    products, log = {}, []
    for d in plan.decisions:
        if not d.run or d.step not in build:
            log.append((d.step, "skipped", 0.0, d.reason))
            if d.step in (blank or {}):
                products[d.step] = spark.createDataFrame([], blank[d.step])
            continue
        began = time.monotonic()
        try:
            products[d.step] = build[d.step]()
        except Exception as e:
            log.append((d.step, "failed", time.monotonic() - began, str(e)[:200]))
            raise
        log.append((d.step, "ran", time.monotonic() - began, d.reason))
    return products, spark.createDataFrame(log, "step string, status string, seconds double, note string")


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("status") == "ran").alias("ran"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("nodes"))


def run_sharded(items: DataFrame, worker: Callable[[int, str], str], parts: int = 4, tries: int = 1) -> DataFrame:
    """Call a Python function on each (i, item) in ``parts`` tasks: (i, result, error) for every item, a failure, after so many
    tries, for its item alone. The order of the result is i, however the items were dealt."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, item in zip(pdf["i"], pdf["item"], strict=True):
                result, error = None, None
                for _ in range(tries):
                    try:
                        result, error = worker(int(i), item), None
                        break
                    except Exception as e:  # noqa: BLE001  isolation of items is the purpose
                        error = f"{type(e).__name__}: {e}"[:200]
                rows.append((i, result, error))
            yield pd.DataFrame(rows, columns=["i", "result", "error"])

    return items.select("i", "item").repartition(parts, "i").mapInPandas(call, "i long, result string, error string").orderBy("i")


def cached_calls(requests: DataFrame, cache: DataFrame, call: Callable[[int, str], str], tries: int = 1) -> tuple[DataFrame, DataFrame]:
    """Answers of an outside model by the hash of their prompt: (answers, rows to append to the cache). Only misses are called,
    each distinct prompt once. ``requests``: id, mode, prompt; ``cache``: key, answer."""
    key = F.substring(F.sha2(F.concat("mode", F.lit("\x00"), "prompt").cast("binary"), 256), 1, 24)
    keyed = requests.withColumn("key", key)
    newest = cache.groupBy("key").agg(F.max("answer").alias("answer"))
    misses = keyed.join(newest, "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("item"))
    fresh = run_sharded(misses.withColumn("i", F.xxhash64("key")), call, tries=tries).filter("error is null").join(misses.withColumn("i", F.xxhash64("key")).select("i", "key"), "i").select("key", F.col("result").alias("answer"))
    answers = keyed.join(newest.unionByName(fresh), "key", "left").select("id", "key", "answer")
    return answers, fresh
