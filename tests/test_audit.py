"""Two audits in one run, against the results that the rules give by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.operators import agent, explain, inquiry, memory, trace
from evidentia.plans.audit import audit
from evidentia.plans.planner import refine, rule_plan, run_sharded, run_steps, totals
from evidentia.sinks.report import markdown
from evidentia.sources.code import code_lines, files_from_text, sanitize
from evidentia.sources.paper import pages_from_text

from .samples import DEMO, EDGE, PAGES


@pytest.fixture(scope="module")
def tables(spark):
    pages = pages_from_text(spark, {"P": PAGES})
    files = files_from_text(spark, DEMO + EDGE)
    audits = spark.createDataFrame([("a", "P", "demo"), ("b", "P", "edge")], "audit_id string, paper_id string, code_id string")
    results = spark.createDataFrame([("a", "accuracy", 91.7), ("a", "loss", 0.38), ("a", "auc", 1.0)], "audit_id string, metric string, value double")
    out = audit(spark, audits, pages, files, results=results)
    return out | {"pages": pages, "files": files, "audits": audits}


def statuses(tables, name):
    rows = tables["findings"].filter(F.col("audit_id") == name).collect()
    return {(r["key"], r["status"]): r["risk"] for r in rows}


def test_demo(tables):
    want = {
        ("learning_rate", "inconsistent"): "high", ("dataset", "inconsistent"): "medium", ("input_size", "missing_in_code"): "medium", ("model", "missing_in_code"): "medium", ("seed", "not_fixed"): "medium",
        ("result_accuracy", "inconsistent"): "high", ("result_loss", "inconsistent"): "high",
    } | {(k, "consistent"): "none" for k in ("batch_size", "dropout", "epochs", "optimizer", "scheduler", "weight_decay")}
    assert statuses(tables, "a") == want
    assert tables["findings"].filter("not verified").count() == 0


def test_edge(tables):
    found = statuses(tables, "b")
    assert len(found) == 12 and sum(s == "consistent" for _, s in found) == 4
    assert found["learning_rate", "internal_inconsistent"] == "low" and found["seed", "inconsistent"] == "low"
    assert [r["file"] for r in tables["failed_files"].collect()] == ["broken.py"]
    assert [(r["value"], r["key"]) for r in tables["rejected"].filter("side = 'code'").collect()] == [("2024", "learning_rate")]


def test_scores(tables):
    got = {(r["audit_id"], r["category"]): r["score"] for r in tables["readiness"].collect()}
    assert got == {("a", "env"): 100, ("a", "data"): 92, ("a", "param"): 61, ("a", "record"): 100, ("a", "result"): 70, ("a", "total"): 85, ("b", "env"): 100, ("b", "data"): 92, ("b", "param"): 57, ("b", "record"): None, ("b", "result"): None, ("b", "total"): 83}
    assert {r["audit_id"]: r["confidence_score"] for r in tables["coverage"].collect()} == {"a": 100, "b": 90}


def test_traces_patches_questions_report(tables):
    traces = trace.traces(tables["findings"], tables["code_evidence"]).persist()
    found = {(r["audit_id"], r["key"]): r["confidence"] for r in traces.collect()}
    assert found["a", "learning_rate"] == "none" and found["a", "dataset"] == "high" and found["b", "learning_rate"] == "medium"
    lines = code_lines(tables["files"]).join(tables["audits"].select("audit_id", "code_id"), "code_id")
    patches = {(r["audit_id"], r["key"]): r for r in trace.patches(tables["findings"], traces, lines, tables["paper_evidence"]).collect()}
    assert patches["a", "learning_rate"]["refuse_kind"] == "no_rootcause"
    assert patches["b", "learning_rate"]["after"] == "LEARNING_RATE = 0.0001"
    none = tables["mentioned"].limit(0).select(F.lit("a").alias("audit_id"), "key")
    questions = inquiry.build_questions(tables["findings"], none, none, tables["failed_files"])
    high = tables["findings"].filter("status = 'inconsistent' and risk = 'high'")
    assert [r["key"] for r in questions.filter("kind = 'conflict'").orderBy("audit_id", "key").collect()] == [r["key"] for r in high.orderBy("audit_id", "key").collect()] and high.count()
    rows = inquiry.repro_rows(tables["findings"])
    assert rows.filter("audit_id = 'b' and key = 'learning_rate'").first()["status"] == "inconsistent; internal_inconsistent"
    report = {r["audit_id"]: r["report"] for r in markdown(tables | {"traces": traces, "questions": questions}).collect()}
    assert "## overview" in report["a"] and "Learning Rate" in report["a"] and report["b"].index("## readiness") < report["b"].index("## findings")


def test_replace_token():
    line = "WARMUP_EPOCHS = 20   # 1 epoch of 1500 steps"
    assert trace.replace_token(line, "1", "1500") == (None, "no_token")
    assert trace.replace_token(line, "20", "30")[0] == "WARMUP_EPOCHS = 30   # 1 epoch of 1500 steps"
    assert trace.replace_token("a = f(3, 3)", "3", "4") == (None, "ambiguous_token")


def test_distribution_call():
    cases = {"Y = rng.normal(": True, "x = np.random.uniform(0, f(2), ": True, "np.random.default_rng(": False, "np.random.seed(": False, "f(rand(1), ": False, "lr = ": False}
    assert {k: agent.in_distribution_call(k) for k in cases} == cases


def test_gate_and_ladder(spark):
    pages = pages_from_text(spark, {"P": ["We set the dropout rate on every task to zero. The weight decay of our runs, found by search, is fixed at 0.05 for all. No momentum is used here in any run of this kind."]})
    c = [("P", 1, "weight_decay", "0.05", "found by search, is fixed at 0.05"), ("P", 1, "weight_decay", "7", "weight decay is 7"), ("P", 1, "dropout", "0.7", "We set the dropout")]
    got = {r["value"]: r["why"] for r in agent.gate(spark.createDataFrame(c, "paper_id string, page_no int, key string, value string, evidence string"), pages).collect()}
    assert got == {"0.05": "", "7": "not_grounded", "0.7": "not_shown"}
    gaps = spark.createDataFrame([("P", "weight_decay"), ("P", "momentum")], "paper_id string, key string")
    assert {(r["key"]) for r in agent.negation_hints(pages, gaps).collect()} == {"momentum"}


def test_planner():
    plan = rule_plan(pages=10, has_code=True, can_read_images=True)
    got = refine(plan, [{"tool": "align", "action": "skip", "reason": "x"}, {"tool": "trace", "action": "skip", "reason": "slow"}, {"tool": "explain", "action": "skip", "reason": " "}, {"tool": "nope", "action": "skip", "reason": "x"}])
    assert {d.step: d.source for d in got.decisions if d.source != "rule"} == {"align": "veto", "trace": "llm", "explain": "veto", "patch": "cascade"}
    assert not rule_plan(pages=10, has_code=False, can_read_images=False).runs("patch") and len(got.notes) == 1


def test_shards(spark):
    def work(i, item):
        if i == 1:
            raise ValueError("no")
        return item * 2

    items = spark.createDataFrame([(i, x) for i, x in enumerate("abcd")], "i long, item string")
    rows = run_sharded(items, work).collect()
    assert [r["result"] for r in rows] == ["aa", None, "cc", "dd"] and rows[1]["error"] == "ValueError: no"


def test_memory(spark):
    rows = [(f"p{i:02d}", "t", 1, None, ["seed"], {"seed": [1, 2]}, 1) for i in range(60)]
    store = spark.createDataFrame(rows, "fp string, title string, runs int, last_seen timestamp, unresolved array<string>, page_hints map<string,array<int>>, scheme int")
    store = store.withColumn("last_seen", F.timestamp_seconds(F.substring("fp", 2, 2).cast("int")))
    kept, folded = memory.split_capacity(store)
    assert kept.count() == 40 and [(r["key"], r["times"], r["pages"]) for r in memory.digest(folded).collect()] == [("seed", 20, [1, 2])]
    again = memory.remember(store, store.filter("fp = 'p07'"))
    assert again.filter("fp = 'p07'").first()["runs"] == 2 and again.count() == 60


def test_sanitize(spark):
    got = spark.range(1).select(sanitize(F.lit("x = 1\n  !ls\n%time f()\ny = %time f()")).alias("x")).first()["x"]
    assert got == "x = 1\n  pass\npass\ny = None"


def test_nothing(spark):
    audits = spark.createDataFrame([("a", "P", None)], "audit_id string, paper_id string, code_id string")
    out = audit(spark, audits, pages_from_text(spark, {"P": [""]}))
    assert out["findings"].count() == 0 and out["coverage"].first()["pages_parsed"] == 0
    assert out["readiness"].filter("category = 'total'").first()["score"] is None


def test_explanations(spark, tables):
    findings = tables["findings"].filter("audit_id = 'a'")
    plain, none = explain.explain(findings)
    by = {r["key"]: r for r in plain.collect()}
    assert none is None and by["learning_rate"]["ratio"] == pytest.approx(10) and "10.0 倍" in by["learning_rate"]["explanation"] and by["seed"]["kind"] == "missing_in_code" or by["seed"]["kind"] == "seed"
    asked = explain.prompts(findings)
    key = F.substring(F.sha2(F.concat("mode", F.lit("\x00"), "prompt").cast("binary"), 256), 1, 24)
    cache = asked.filter("key = 'dataset'").select(key.alias("key"), F.lit("known").alias("answer"))

    def call(_, prompt):
        if "Learning Rate" in prompt:
            raise RuntimeError("no answer")
        return "said"

    rows, fresh = explain.explain(findings, cache, call)
    got = {r["key"]: (r["source"], r["explanation"]) for r in rows.collect()}
    assert got["dataset"] == ("model", "known") and got["learning_rate"][0] == "template" and got["model"] == ("model", "said")
    assert fresh.filter("answer = 'said'").count() == len(got) - 2


def test_outcomes_and_blank_products(spark, tables):
    traces = trace.traces(tables["findings"], tables["code_evidence"])
    drafts = spark.createDataFrame([("a", "proposed"), ("a", "refused")], "audit_id string, status string")
    fills = spark.createDataFrame([("a", True), ("a", False)], "audit_id string, ok boolean")
    said = {(r["audit_id"], r["step"]): r["outcome"] for r in explain.outcomes(tables["coverage"], tables["findings"], traces, drafts, fills).collect()}
    assert said["a", "patch"] == "2 个参数, 1 份草案" and said["a", "parse_paper"].startswith("3/3 页") and ("b", "patch") not in said
    plan = refine(rule_plan(has_code=False, pages=3, can_read_images=False), [])
    done, log = run_steps(spark, plan, {}, {"trace": "audit_id string", "patch": "audit_id string"})
    assert done["trace"].count() == 0 and done["patch"].columns == ["audit_id"]
    assert totals(plan)["ran"] + totals(plan)["skipped"] == log.count()


def test_nominated_patches(spark, tables):
    lines = code_lines(tables["files"]).join(tables["audits"].select("audit_id", "code_id"), "code_id")
    named = spark.createDataFrame([("b", "learning_rate", "1e-4", "train.py", 1), ("b", "learning_rate", "0.5", "train.py", 1), ("b", "learning_rate", "1e-4", "train.py", 99)], "audit_id string, key string, value string, file string, line int")
    got = trace.nominated_patches(named, tables["findings"], tables["paper_evidence"], tables["code_evidence"], lines).collect()
    assert [(r["status"], r["after"], r["source"], r["needs_human"]) for r in got] == [("proposed", "LEARNING_RATE = 0.0001", "model", True)]
    assert got[0]["diff"].split("\n")[:5] == ["--- a/train.py", "+++ b/train.py", "@@ -1,4 +1,4 @@", "-LEARNING_RATE = 0.001", "+LEARNING_RATE = 0.0001"] and got[0]["diff"].split("\n")[5] == " BATCH_SIZE = 32"


def test_flattened_table_in_the_page(spark):
    """Evidence that is cut out of a row of numbers is refused by its page."""
    pages = pages_from_text(spark, {"P": ["Methods A B\nEpochs\n300 300 Batch size 4096 1024 2048 more."]})
    c = [("P", 1, "batch_size", "300", "300 Batch size"), ("P", 1, "batch_size", "4096", "Batch size 4096")]
    got = {r["value"]: r["why"] for r in agent.gate(spark.createDataFrame(c, "paper_id string, page_no int, key string, value string, evidence string"), pages).collect()}
    assert got == {"300": "flattened_table", "4096": "flattened_table"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "pages.json").write_text(json.dumps(PAGES), encoding="utf-8")
    (tmp_path / "code").mkdir()
    for _, name, text in DEMO:
        (tmp_path / "code" / name).write_text(text, encoding="utf-8")
    (tmp_path / "results.json").write_text('{"accuracy": 91.7}')
    cli.main([str(tmp_path / "pages.json"), str(tmp_path / "code"), str(tmp_path / "results.json"), "--out", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "Learning Rate: inconsistent (high)" in said and (tmp_path / "out" / "report.md").read_text(encoding="utf-8").startswith("# Audit")
