"""Code of lines against a scan of whole files, with files that are cut into stretches, and evidence that ignores comments."""

from __future__ import annotations

import random

import pytest

from evidentia.operators import lexical
from evidentia.operators.extract_code import multilang_evidence

MARKS = {"c": "cpp", "m": "m", "jl": "jl", "r": "r", "ps1": "ps1", "yaml": "yaml"}


def whole_file(lines, extension):
    """States carried from line to line."""
    inside, out = False, []
    for line in lines:
        code, inside = lexical.scan_line(line, inside, lexical.BLOCKS.get(extension, ("", "", False)))
        out.append(code)
    return out


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(lexical, "STRETCH", stretch)
    rng = random.Random(5)
    parts = ["/*", "*/", "#=", "=#", "<#", "#>", "%{", "%}", "//", "#", "%", "--", '"', "'", "x = 1", " ", "http://a#b", "\\", "lr", ":"]
    rows, want = [], {}
    for k in range(60):
        e = rng.choice([*lexical.BLOCKS, "r", "yaml"])
        lines = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 14))]
        rows += [(f"f{k}.{e}", i, x) for i, x in enumerate(lines)]
        want.update({(f"f{k}.{e}", i): c for i, c in enumerate(whole_file(lines, e))})
    found = lexical.code_of_lines(spark.createDataFrame(rows, "file string, line_no int, line string").repartition(4), ["file"])
    assert {(r["file"], r["line_no"]): r["code"] for r in found.collect()} == want
    assert found.columns == ["file", "line_no", "line", "code"]


@pytest.mark.parametrize(("line", "inside", "extension", "code", "ends"), [
    ('u = "http://a#b" // lr = 3', False, "cpp", 'u = "http://a#b" ', False), ("a /* b */ c /* d", False, "c", "a  c  ".rstrip(" ") + " ", True), ("still */ lr = 0.1", True, "cu", "  lr = 0.1", False),
    ("x = 'don''t' # y", False, "r", "x = 'don''t' ", False), ("it's # a comment", False, "yaml", "it's ", False), ("%{", False, "m", "", True), ("x = 5 %{ not alone", False, "m", "x = 5 ", False), ("%}", True, "m", "", False),
    ("#= a =# lr = 1", False, "jl", " lr = 1", False), ("lr: 3", True, "yaml", "lr: 3", False), ("url: http://x", False, "yaml", "url: http://x", False),
])
def test_scan_line(line, inside, extension, code, ends):
    marks = lexical.BLOCKS.get(extension, ("", "", False))
    got = lexical.scan_line(line, inside and bool(marks[0]), marks)
    assert (" ".join(got[0].split()), got[1]) == (" ".join(code.split()), ends)


def test_evidence_without_comments(spark):
    files = [
        ("a.cpp", "/* lr = 0.5\n batch_size = 3 */ lr = 0.01;\nurl = 'http://a#b'; // epochs = 9\nepochs = 7;"),
        ("b.m", "%{\nmomentum = 0.5\n%}\nmomentum = 0.9; % note\n"), ("c.jl", "#= seed = 1\n =# seed = 5\n"), ("d.yaml", "dropout: 0.3 # lr: 1\nmodel: 'resnet#50'\n"),
    ]
    found = multilang_evidence(spark.createDataFrame([("x", p, "lang", t) for p, t in files], "code_id string, path string, kind string, text string"))
    assert {(r["file"], r["key"], r["raw_value"]) for r in found.collect()} == {("a.cpp", "learning_rate", "0.01"), ("a.cpp", "epochs", "7"), ("b.m", "momentum", "0.9"), ("c.jl", "seed", "5"), ("d.yaml", "dropout", "0.3")}
