"""Budgets of the ladder: who is served, what is left out, and that no port is called twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators.budget import Budget, fill_within
from evidentia.schemas import READINGS

KEYS = ["batch_size", "dropout", "epochs", "momentum", "seed", "weight_decay"]
CANDIDATES = "paper_id string, page_no int, key string, value string, evidence string"


def test_budgets(spark):
    texts = {"A": "The batch size = 32 was small. We use no dropout here. Tables tell: momentum in use was about 0.9 there. Of epochs, seed and weight decay nothing is told.", "B": "epochs and seed"}
    pages = spark.createDataFrame([(p, 1, t, 0) for p, t in texts.items()], "paper_id string, page_no int, text string, n_images int")
    mentioned = spark.createDataFrame([("A", k) for k in KEYS] + [("B", "epochs"), ("B", "seed")], "paper_id string, key string")
    evidence = spark.createDataFrame([], "owner_id string, key string")
    asked = []

    def propose(requests):
        asked.append(sorted(map(tuple, requests.collect())))
        given = {("A", "dropout"): "0.5", ("A", "epochs"): "7"}
        rows = [(p, 1, k, v, "momentum in use was about 0.9 there" if k == "dropout" else f"epochs of {v}") for (p, k), v in given.items() if (p, k) in asked[-1]]
        return spark.createDataFrame(rows, CANDIDATES)

    def read(requests):
        asked.append(sorted(map(tuple, requests.collect())))
        rows = [(p, 1, "table", run, k, {"dropout": "0.3", "epochs": str(run)}.get(k, "1"), "seen") for p, k in asked[-1] for run in (1, 2)]
        return spark.createDataFrame(rows, READINGS)

    out = fill_within(pages, mentioned, evidence, propose, read, Budget(model=2, images=2))
    fills = {(r["paper_id"], r["key"]): (r["tool"], r["value"]) for r in out["fills"].collect()}
    assert fills["A", "batch_size"] == ("text-l1", "32") and fills["A", "dropout"] == ("images", "0.3")
    open_to_model = sorted(("A", k) for k in KEYS if fills.get(("A", k), ("",))[0] not in ("text-l1", "text-l2"))
    assert asked[0] == open_to_model[:2] + [("B", "epochs"), ("B", "seed")]  # two calls a paper, in the order of keys
    assert len(asked) == 2 and [k for p, k in asked[1] if p == "A"] == [k for _, k in open_to_model][:2]
    ledger = {(r["paper_id"], r["kind"]): (r["calls"], r["left_out"]) for r in out["ledger"].collect()}
    assert ledger["A", "model"] == (2, len(open_to_model) - 2) and ledger["B", "model"] == (2, 0) and ledger["B", "images"] == (2, 0)
    trace = {(r["paper_id"], r["key"], r["tool"]): r["status"] for r in out["trace"].collect()}
    assert trace["A", "dropout", "negation"] == "hinted" and trace["A", "dropout", "model"] == "rejected" and trace["A", "weight_decay", "model"] == "skipped"
    assert trace["A", "epochs", "images"] == "no_hit"  # the two runs do not agree
    assert out["trace"].groupBy("paper_id", "key").agg(F.max("attempt").alias("n")).filter("n > 5").count() == 0
    left = {(r["paper_id"], r["key"]) for r in out["unfilled"].collect()}
    assert left.isdisjoint(fills) and left | set(fills) == {("A", k) for k in KEYS} | {("B", "epochs"), ("B", "seed")}


def test_without_ports(spark):
    pages = spark.createDataFrame([("A", 1, "seed", 0)], "paper_id string, page_no int, text string, n_images int")
    out = fill_within(pages, spark.createDataFrame([("A", "seed")], "paper_id string, key string"), spark.createDataFrame([], "owner_id string, key string"))
    assert out["ledger"].count() == 0 and out["fills"].count() == 0 and [tuple(r) for r in out["unfilled"].collect()] == [("A", "seed")]
