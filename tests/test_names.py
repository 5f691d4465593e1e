"""The automaton of names against one pattern for each name, on random texts of names, numbers and separators."""

from __future__ import annotations

import random
import re
import time

import pytest

from evidentia import patterns as P
from evidentia.dims import PARAMS, TEXT_VALUED
from evidentia.functions.names import NameIndex, bounded, fold, spaced
from evidentia.operators import agent
from evidentia.operators import extract_paper as paper

NAMES = [a for _, names in PARAMS.values() for a in names]


def texts(n):
    rng = random.Random(7)
    other = ["is", "=", ":", "was set to", "of", "为", "设置为", "取", "0.1", "32", "1e-4", "zero", "none", "×", "(", ")", "[3]", ".", "。", "\n", ",", "the", "not", "without", "不使用", "omitted", "İ", "ſeed", "Kernel", "design iterations", "_", "-", "x"]
    glue = ["", " ", " ", " ", "  ", "\t", " ", "\n"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 60)):
            name = rng.choice(NAMES)
            name = rng.choice([name, name, name.upper(), name.title(), name.replace(" ", "_"), name.replace("_", " "), name.replace("_", "-"), name + "s", "x" + name])
            parts += [rng.choice([name, *rng.choices(other, k=2)]), rng.choice(glue)]
        yield "".join(parts)


def forward_by_name(text):
    for key, names in ((k, n) for k, (_, n) in PARAMS.items() if k not in ("optimizer", "scheduler", "model")):
        for alias in names:
            for m in re.finditer(paper._forward(alias), text):
                yield paper.FORWARD, key, m[m.lastindex].strip(), m.start(), m.end()


def gaps_by_name(finder, text):
    """What a search of each name in each sentence finds."""
    other = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(map(spaced, sorted({a for a in NAMES if len(a) >= 6 or " " in a or "_" in a}, key=len, reverse=True))) + r")(?![A-Za-z0-9_])")
    done = set()
    for sentence in finder.sentence.finditer(text):
        for key, alias in ((k, a) for k, (_, n) in PARAMS.items() if k not in TEXT_VALUED for a in n):
            hit = re.search(bounded(alias), sentence[0], re.IGNORECASE)
            if key in done or not hit:
                continue
            tail = sentence[0][hit.end() : hit.end() + P.GAP_LIMIT]
            for found, value in ((finder.number.search(tail), None), (finder.word.search(tail), "0")):
                if found and finder.connector.search(gap := tail[: found.start()]) and not finder.bad_gap.search(gap) and not other.search(gap):
                    done.add(key)
                    yield key, value or found[1], sentence.start(), sentence.start() + hit.end() + found.end()
                    break


def kinds_by_name(low):
    for key, (_, names) in PARAMS.items():
        text = re.sub(P.ALIAS_VETO[key], " ", low) if key in P.ALIAS_VETO else low
        plain = "|".join(re.escape(a.lower()).replace(r"\ ", r"[ \t\n\x0b\f\r_\-]") for a in names if not paper._CJK.search(a))
        if re.search(rf"(?<![a-z0-9_])(?:{plain})(?![a-z0-9_])", text) or any(a.lower() in text for a in names if paper._CJK.search(a)):
            yield key


def test_same_hits():
    finder, found = paper._Finder(), [0, 0, 0]
    for text in texts(2000):
        places = finder.index.places(text)
        want = list(forward_by_name(text))
        assert list(finder.forward(text, places)) == want
        gaps = list(gaps_by_name(finder, text))
        assert list(finder.gaps(text, places)) == gaps
        kinds = set(kinds_by_name(text.lower()))
        assert paper.kinds_named(finder.index, text.lower()) == kinds
        found = [found[0] + len(want), found[1] + len(gaps), found[2] + len(kinds)]
    assert min(found) > 500


def test_fold_keeps_places():
    text = "İI ſKK a-b_ﬁßẞΣ　漢"
    assert len(fold(text)) == len(text) and fold(text).startswith("ii skk a b ")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"p{i % 40}", i, t, 0) for i, t in enumerate(texts(400))] + [("p1", 900, None, 0), ("p2", 901, "", 0)]
    return spark.createDataFrame(rows, "paper_id string, page_no int, text string, n_images int").persist()


def test_mentioned_kinds(spark, pages):
    want = {(r["paper_id"], k) for r in pages.collect() for k in kinds_by_name((r["text"] or "").lower())}
    assert {tuple(r) for r in paper.mentioned_kinds(pages).collect()} == want


def test_negation_hints_and_scan(spark, pages):
    gaps = pages.select("paper_id").distinct().crossJoin(spark.createDataFrame([(k,) for k in ("dropout", "seed", "batch_size", "epochs", "model")], "key string"))
    want_hints, want_scan = set(), set()
    for r in pages.collect():
        text = re.sub(r"\s+", " ", r["text"] or "", flags=re.ASCII).strip()
        for key in ("dropout", "seed", "batch_size", "epochs", "model"):
            alias = "|".join(a.replace("_", "[_ ]") for a in PARAMS[key][1])
            if re.search(rf"(?ai)(?:\b(?:no|not|without|never|omit\w*|disable\w*)\b|不使用|未使用|没有使用|未采用|不采用|无需|不含)[^.。]{{0,{agent.NEGATED}}}(?:{alias})", text):
                want_hints.add((r["paper_id"], key, r["page_no"]))
            if key in TEXT_VALUED:
                continue
            name = re.compile("(?i)" + "|".join(bounded(a) for a in sorted(PARAMS[key][1], key=len, reverse=True)))
            for s in re.finditer(P.SENTENCE, r["text"] or ""):
                if (hit := name.search(s[0])) and (after := re.search(P.NUM_B, s[0][hit.end() :])) and re.match(r"^[\s×xX*\-–—/·=:]*$", s[0][hit.end() :][: after.start()]):
                    want_scan.add((r["paper_id"], r["page_no"], key, after[1], s[0]))
    assert {tuple(r) for r in agent.negation_hints(pages, gaps).collect()} == want_hints and want_hints
    names = gaps.groupBy("paper_id").agg({"key": "collect_set"}).toDF("paper_id", "keys")
    found = pages.join(names, "paper_id").select("paper_id", "page_no", "text", "keys").mapInPandas(agent._scan, "paper_id string, page_no int, key string, level int, value string, before string, after string, head string, evidence string")
    got = {(r["paper_id"], r["page_no"], r["key"], r["value"], r["evidence"]) for r in found.filter("level = 1").collect()}
    assert want_scan <= got and want_scan


def test_time_does_not_grow_with_names():
    """Ten times the names, most of which a page does not hold, cost a page about what they cost before."""
    words = random.Random(3)
    page = " ".join(words.choice(["some", "prose", "about", "networks", "and", "their", "training", "batch size 32", "学习率 0.1"]) for _ in range(4000))
    made = {f"k{i}": (f"k{i}", ["".join(words.choices("qxzvwj", k=12)) for _ in range(10)]) for i in range(len(NAMES))}
    seconds = []
    for params in (PARAMS, {**PARAMS, **made}):
        finder = paper._Finder(params)
        list(finder.hits(page))
        began = time.process_time()
        for _ in range(5):
            places = finder.index.places(page)
            list(finder.forward(page, places)), list(finder.gaps(page, places)), paper.kinds_named(finder.index, page)
        seconds.append(time.process_time() - began)
    assert len(NameIndex({**PARAMS, **made}).entries) > 10 * len(NAMES)
    assert seconds[1] < 2 * seconds[0]
