"""Sources, sinks and small operators: archives, folders, decoders, results, purges, reports, memory lines, plans' totals."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from evidentia.operators import agent, extract_code, memory
from evidentia.plans.planner import rule_plan, log_totals, run_steps, totals
from evidentia.schemas import MEMORY
from evidentia.sinks import report
from evidentia.sources import code, paper


def test_archives_and_folders(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("src/train.py", "lr = 0.1\n")
        z.writestr("config.yaml", "batch_size: 3\n")
        z.writestr("a.bin", b"\x00\xff")
    (tmp_path / "zips/one.zip").write_bytes(data.getvalue())
    (tmp_path / "zips/broken.zip").write_bytes(b"not an archive")
    found = {(r["code_id"], r["path"]): (r["kind"], r["text"]) for r in code.read_archives(spark, f"file://{tmp_path}/zips").collect()}
    assert found["one", "src/train.py"] == ("py", "lr = 0.1\n") and found["one", "config.yaml"][0] == "config" and not any(k == "broken" for k, _ in found)
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/sub/x.R").write_text("lr <- 0.1")
    assert [(r["path"], r["kind"], r["text"]) for r in code.read_folder(spark, f"file://{tmp_path}/tree", "c").collect()] == [("sub/x.R", "lang", "lr <- 0.1")]
    assert code.read_folder(spark, "", "c").count() == 0


def test_decoders_prints_and_results(spark, tmp_path):
    (tmp_path / "p1.bin").write_bytes(b"first|second")
    (tmp_path / "p2.bin").write_bytes(b"bad")

    def decode(content):
        if content == b"bad":
            raise ValueError
        return [(x, 1) for x in content.decode().split("|")]

    pages = paper.decoded_pages(spark, f"file://{tmp_path}/*.bin", decode)
    assert sorted(map(tuple, pages.collect())) == [("p1", 1, "first", 1), ("p1", 2, "second", 1)]
    assert paper.page_counts(pages).first()["pages"] == 2
    prints = {r["paper_id"]: r["fp"] for r in paper.fingerprints(spark, f"file://{tmp_path}/*.bin").collect()}
    assert len(set(prints.values())) == 2 and all(len(x) == 10 for x in prints.values())
    (tmp_path / "r").mkdir()
    (tmp_path / "r/audit7.json").write_text(json.dumps({"accuracy": 91.5, "note": None}))
    assert [tuple(r) for r in paper.read_results(spark, f"file://{tmp_path}/r").collect()] == [("audit7", "accuracy", 91.5)]
    assert paper.purge(spark, [f"file://{tmp_path}/r", f"file://{tmp_path}/none"])[0][1] > 0 and not (tmp_path / "r").exists()


def test_image_regions(spark):
    pages = spark.createDataFrame([("p", 1, "", 0), ("p", 2, "the learning rate of our model " * 20, 1), ("p", 3, "plain prose " * 60, 1)], "paper_id string, page_no int, text string, n_images int")
    images = spark.createDataFrame([("p", 2, 1, 0.5), ("p", 2, 2, 0.1), ("p", 3, 1, 0.9)], "paper_id string, page_no int, image_no int, share double")
    found = [(r["page_no"], r["region_kind"], r["image_no"]) for r in paper.image_regions(pages, images).orderBy("rank").collect()]
    assert found == [(2, "image", 1), (1, "page", 0)]  # no region of a page without parameter words, none that is small
    assert paper.image_regions(pages, images, most=1).count() == 1


def test_memory_lines(spark):
    rows = [("f", "t", 2, None, ["seed", "lr"], {"seed": [3]}, 1), ("g", "t", 1, None, ["seed"], {}, 0)]
    store = spark.createDataFrame(rows, MEMORY)
    assert [r["line"] for r in memory.hint_lines(memory.recall(store, store)).collect()] == ["第 3 次审计: 上次未取到 seed, lr"]
    folded = memory.digest(store)
    lines = {r["key"]: r["line"] for r in memory.digest_lines(folded).collect()}
    assert lines["lr"].endswith("1 次未取到") and lines["seed"].endswith("曾见于第 3 页")
    assert [(r["key"], r["times"]) for r in memory.unresolved_statistics(store, folded).collect()] == [("seed", 4), ("lr", 2)]
    assert memory.capacity(store, 5).select("detail", "digested", "most").first() == (2, 5, memory.KEEP)


def test_code_counts(spark):
    files = code.files_from_text(spark, [("c", "tests/a.py", "seed = 3\n"), ("c", "train.py", "lr = 0.1\n"), ("c", "run.jl", "epochs = 3\n")])
    evidence, _ = extract_code.code_evidence(files)
    assert [r["key"] for r in extract_code.aux_only_keys(evidence).collect()] == ["seed"]
    assert [(r["file"], r["language"], r["n"]) for r in extract_code.language_counts(evidence).collect()] == [("run.jl", "Julia", 1)]


def test_answers_and_plans(spark):
    said = spark.createDataFrame([('text {"a": 1} more',), ("none",), ("{broken",)], "t string").select(F.to_json(agent.rescue_json(F.col("t"))).alias("j")).collect()
    assert [r["j"] for r in said] == ['{"a":1}', None, None]
    plan = rule_plan(pages=1, has_code=False, can_read_images=False)
    products, log = run_steps(spark, plan, {d.step: (lambda: spark.range(1)) for d in plan.decisions if d.run})
    assert log_totals(log).first()["ran"] == len(products) == totals(plan)["ran"] and totals(plan)["skipped"] > 0


def test_reports_on_disk(spark, tmp_path):
    reports = spark.createDataFrame([("a", "# Audit\nline"), ("b", "x")], "audit_id string, report string")
    report.write_reports(reports, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["audit_id=a", "audit_id=b"]
    rows = spark.createDataFrame([("a", "k", "LR", "0.1", None, "fix it")], "audit_id string, key string, display string, paper_value string, code_value string, advice string")
    assert report.repro_markdown(rows).first()["pack"].endswith("| LR | 0.1 | - | fix it |")
