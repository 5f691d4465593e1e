"""The ten operators on small tables: against brute force or a library, with nulls, empty and repeated rows."""

from __future__ import annotations

import collections
import math
import random
import re
import textwrap
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import bpe, html_text, jaccard_join, kneser_ney, license_scan, mixing, quality_net, quality_rules, session, shared_arrays, token_counts, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n"), (None, "no id at all"), (6, "Ünïcödé 漢字 ﬁ <|endoftext|> don't İΣ"), (7, "x " * 3000), (8, "line\nline\nline\n" * 5),
]


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 4 else "en", "s", 0, 9) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", score int")  # "score" clashes with outputs


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    docs = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        docs.append(words)
        if i % 4 == 0:  # near copies by a few edits
            for k in range(1, 4):
                copy = list(words)
                for _ in range(k):
                    copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10**6)
                docs.append(copy)
    docs += [docs[0]] * 5
    rows = [(i, " ".join(w), "en" if i % 3 else "fr", f"s{i % 2}", 0) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS), rows


def test_bpe_equals_the_library(spark, odd, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.BacktrackingBPE(open(path, encoding="utf-8").read())
    texts = [t or "" for _, t in ODD] + [r[1] for r in corpus[1][:20]] + ["the THE's ''' !!!??? 12345 ab", "naïve café́ Å", "a\x1cb\x85c\xa0d"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    there = bpe.decode(bpe.encode(odd, "text", path), "ids", path)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in there.collect())
    rows = bpe.encode_round_trip(odd, path).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}


def test_quality_net(spark, odd):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
        bad = i % 3 == 0
        docs.append((i, " ".join(w + "###" if bad else w for w in words), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    net = quality_net.fit_network(docs, labels)
    rows = quality_net.quality_scores(docs, net).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_net.quality_scores(odd, net).collect())
    assert quality_net.fit_network(docs, labels.limit(0)).constant == 0.5
    assert quality_net.keep_good(odd, net).columns == odd.columns


def test_network_gradient():
    net = quality_net.ByteConvNet()
    net.weights[:] = 0.3
    text = b"some words here words words and more of it " * 30
    grads = [np.zeros(p.shape, np.float64) for p in (net.embed, net.filters, net.shift, net.weights, net.bias)]
    net._gradient(text, 1, 1.0, grads)
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    loss = lambda: -math.log(net.scores(raw, off)[0])
    for param, grad, at in ((net.weights, grads[3], 2), (net.bias, grads[4], 0), (net.shift, grads[2], 1)):
        old = param[at]
        param[at] = old + 1e-3
        up = loss()
        param[at] = old - 1e-3
        down = loss()
        param[at] = old
        assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=2e-2, abs=1e-4)


def _base(text):
    w = WORD.findall(text or "")
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, hit = collections.Counter(five), set()
    for i, x in enumerate(five):
        if count[x] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, corpus):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality_rules.base_statistics(odd).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(_base(t) for _, t in ODD)
    junk = spark.createDataFrame([(9000 + k, "word### " * 3 + " ".join(f"w{j}$$$" for j in range(80)), "en", "s0", 0) for k in range(6)], DOCS)
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(corpus[0].unionByName(junk)).collect()}
    assert not any(rows[i]["kept"] for i in rows if i >= 9000)
    assert all(r["kept"] or r["base_failed"] for i, r in rows.items() if i < 9000)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert quality_rules.keep_sound(odd).columns == odd.columns


@pytest.mark.parametrize("copies", [True, False])
def test_quality_rules_third_of_junk(spark, copies):
    """A third of a group is junk, as copies of one text or scattered: none of it is kept, and the rest stays."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200))), "en", "s", 0) for i in range(400)]
    for i in range(200):
        k = 0 if copies else i
        rows.append((9000 + i, " ".join(f"w{k}x{j}" + "$#" * (2 + (k + j) % 3) for j in range(80 + k % 40)), "en", "s", 0))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r["base_failed"] for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 9000)
    assert all(r["kept"] for r in got if r["doc_id"] < 9000)


def test_quality_rules_against_brute_force(spark):
    """Distances and verdicts are those of a plain estimate with exact halves from many random starts."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    texts = []
    for i in range(700):
        words = [rng.choice(vocab) + ("#" if rng.random() < 0.01 else "") for _ in range(rng.randint(40, 300))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        texts.append("\n".join(lines + lines[:1] * (i % 3 == 0)) if i % 5 else " ".join(w + "$$$" for w in words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    rows = quality_rules.robust_verdicts(quality_rules.base_statistics(docs)).orderBy("doc_id").collect()
    x = np.array([[math.log((r["word_chars"] + 250) / (r["n_words"] + 50)), math.sqrt(r["n_symbols"] / (r["n_words"] + 50)), r["n_dup_lines"] / (r["n_lines"] + 5), r["n_repeat_words"] / (r["n_words"] + 50)] for r in rows])
    sound = np.array([not r["base_failed"] for r in rows])
    floor = np.diag(np.square(quality_rules.FLOORS))

    def estimate(part, share):
        mean = part.mean(axis=0)
        return mean, quality_rules._consistency(share) * ((part - mean).T @ (part - mean) / len(part)) + floor

    distance = lambda m, c: np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)
    half, best = sound.sum() // 2, None
    for seed in range(40):
        m, c = estimate(x[np.random.default_rng(seed).choice(np.flatnonzero(sound), 12, replace=False)], 0.5)
        for _ in range(60):
            near = np.argsort(np.where(sound, distance(m, c), np.inf))[:half]
            m, c = estimate(x[near], 0.5)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    d = distance(*best[1:])
    d = distance(*estimate(x[sound & (d <= quality_rules.NEAR)], quality_rules.NEAR_SHARE))
    got = np.array([r["d2"] for r in rows])
    clear = np.abs(d - quality_rules.CUTOFF) > 3  # the halves are cut within a bin of distances, so that distances differ a little
    assert clear.mean() > 0.9
    assert ([r["kept"] for r in rows] == ((d <= quality_rules.CUTOFF) & sound))[clear].all()
    assert np.median(np.abs(got - d) / (d + 1)) < 0.1
    assert sum(not r["kept"] for r in rows) >= 130


def test_consistency_factor():
    x = np.random.default_rng(0).normal(size=(400_000, 4))
    d = (x**2).sum(axis=1)
    inside = x[d <= np.quantile(d, 0.75)]
    assert quality_rules._consistency(0.75) == pytest.approx(1 / inside.var(axis=0).mean(), rel=0.01)


def test_mixing(spark, corpus, odd):
    docs = corpus[0].withColumn("text", F.when(F.col("lang") == "fr", F.regexp_replace("text", "[aeiou]", "é")).otherwise(F.col("text")))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = mixing.mixing_rates(docs, labels, {"en": 0.5, "fr": 0.5}).collect()
    total = sum(r["n_tokens"] for r in rows)
    got = sum(r["n_tokens"] * r["rate"] for r in rows if r["domain"] == "fr")
    assert got / total == pytest.approx(0.5, abs=0.05) and all(r["rate"] >= 0 for r in rows)
    assert mixing.mix(docs, labels).columns == docs.columns
    assert mixing.mixing_rates(odd, labels.limit(0)).filter("rate = 1.0").count() == len(ODD)


def _languages(shares):
    """Documents whose words are those of their language, for numbers of documents by language."""
    rng, rows = random.Random(5), []
    for lang, n in shares.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(f"{lang}{rng.randrange(50)}" for _ in range(60)), lang, "s", 0))
    return rows


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "d": 0.5}])
def test_mixing_small_domains(spark, targets):
    """A domain of one per cent meets its target."""
    docs = spark.createDataFrame(_languages({"a": 900, "b": 60, "c": 30, "d": 10}), DOCS)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = mixing.mixing_rates(docs, labels, targets).collect()
    roots = {k: math.sqrt(v) for k, v in {"a": 900, "b": 60, "c": 30, "d": 10}.items()}
    want = targets or {k: v / sum(roots.values()) for k, v in roots.items()}
    for d in "abcd":
        got = sum(r["n_tokens"] * r["rate"] for r in rows if r["domain"] == d) / sum(r["n_tokens"] for r in rows)
        assert got == pytest.approx(want.get(d, 0), abs=0.005)


def test_mixing_by_source(spark):
    """Another column may name the domains; an empty table has no rows."""
    docs = spark.createDataFrame(_languages({"a": 300, "b": 100}), DOCS).withColumn("source", F.col("lang")).withColumn("lang", F.lit("en"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = mixing.mixing_rates(docs, labels, {"a": 0.5, "b": 0.5}, "source").collect()
    assert sum(r["n_tokens"] * r["rate"] for r in rows if r["domain"] == "b") / sum(r["n_tokens"] for r in rows) == pytest.approx(0.5, abs=0.01)
    assert mixing.mixing_rates(docs.limit(0), labels).count() == 0 and mixing.mix(docs.limit(0), labels).count() == 0


def test_mixing_many_domains(spark):
    """Every labelled language is a domain, and soft mass counts in full."""
    shares = {f"l{i}x": 30 for i in range(20)} | {"rare": 1}
    docs = spark.createDataFrame(_languages(shares), DOCS)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = mixing.mixing_rates(docs, labels).collect()
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert {r["domain"] for r in rows} == set(shares) and all(r["domain"] == langs[r["doc_id"]] for r in rows)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mixing_rates(docs, labels, {"l1x": 0.5, "nowhere": 0.5})
    model = mixing.fit_classifier(docs, labels)
    text = b"l1x1 l2x2 l3x3 other words"
    _, p = model.posteriors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert p.sum() == pytest.approx(1) and (p > 0).all() and (p < 1 / 64).any()


def test_token_counts(spark, odd, corpus):
    from tokenizers import Tokenizer, models

    scores = token_counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.UnigramTrie(scores)

    def brute(word):
        text = token_counts.MARK + word
        best = [(0, 0)] + [None] * len(text)
        for j in range(1, len(text) + 1):
            n = len(text[j - 1].encode())
            options = [(best[j - 1][0] + n * trie.byte, -(-best[j - 1][1] + n))]
            options += [(best[i][0] + scores[text[i:j]], best[i][1] - 1) for i in range(j) if text[i:j] in scores]
            best[j] = max(options)
        return -best[-1][1]

    words = {w for r in corpus[1] for w in r[1].split()} | {"漢字", "naïve", "🙂", "internationalisation"}
    assert all(trie.count(w) == brute(w) for w in words)
    library = Tokenizer(models.Unigram([("<unk>", -99.0), *[(p, s / token_counts.UNIT) for p, s in scores.items()]], 0))
    same = [trie.count(w) == len(library.encode(token_counts.MARK + w).ids) for w in words if w.isascii()]
    assert np.mean(same) > 0.99  # equal sums may be split in another way
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(odd, scores).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[5]["n_words"] == 14


def _components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, corpus, monkeypatch, small):
    if small:  # the way of very large lists
        monkeypatch.setattr(jaccard_join, "WHOLE", 2)
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    want = _components([(r[0], r[1]) for r in corpus[1]])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(corpus[0]).collect()}
    assert got == want


def test_jaccard_index():
    """Intersections by ranges of positions, and those derived from a pivot's, are those of the sets."""
    rng = np.random.default_rng(9)
    pivot = np.unique(rng.integers(0, 400, 120).astype(np.uint64))
    sets = [np.unique(np.append(pivot[rng.random(len(pivot)) < keep], rng.integers(0, 900, n).astype(np.uint64))) for keep in (0.0, 0.5, 0.95) for n in range(1, 30)]
    sets = sorted([*sets, pivot], key=len)
    index = jaccard_join._Index(sets)
    of_pivot = index.overlaps(pivot, 0, len(sets))
    for low, high in ((0, len(sets)), (10, 60), (5, 5), (87, 88)):
        for s in sets:
            want = [len(np.intersect1d(s, x)) for x in sets[low:high]]
            assert index.overlaps(s, low, high).tolist() == want == index.derived(s, pivot, of_pivot[low:high], low, high).tolist()


def test_jaccard_odd(spark, odd):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[5]["component_id"] == 5
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_pipeline_near_duplicates(spark):
    """Near copies by five words at 0.8 that are none by four words at 0.85, and a pair under both rules."""
    words = [f"w{i}" for i in range(100)]
    edited = ["x" if i == 30 else "y" if i == 70 else w for i, w in enumerate(words)]
    longer = [f"a{i}" for i in range(100)] + [f"b{i}" for i in range(20)]
    far = [f"c{i}" for i in range(100)]
    texts = [words, edited, longer[:100], longer, far, ["z" if i % 30 == 9 else w for i, w in enumerate(far)]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 4, 5]
    assert jaccard_join.keep_one(docs).count() == 6


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_stages_judge_rows(spark, monkeypatch, sent):
    """Rows that share an id, or have none, are judged by themselves, whichever way the rejected ones are joined."""
    monkeypatch.setattr(session, "SENT_ROWS", sent)
    monkeypatch.setattr(jaccard_join, "SENT_ROWS", sent)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (1, "few words"), (None, good), (None, "few"), (2, good + " x"), (3, None), (4, good.upper()), (4, good.upper()), (5, "other " + good[::-1]), (5, "other " + good[::-1])]
    docs = spark.createDataFrame([(i, t, "en", None, k) for k, (i, t) in enumerate(rows)], DOCS)
    assert sorted(r["n_chars"] for r in quality_rules.keep_sound(docs).collect()) == [0, 2, 4, 6, 7, 8, 9]
    left = jaccard_join.keep_one(docs).collect()
    assert collections.Counter(r["doc_id"] for r in left) == {None: 2, 1: 1, 3: 1, 5: 1}
    assert all(jaccard_join.keep_one(docs.limit(0)).columns == docs.columns for _ in (0,))


def test_licenses(spark, odd):
    mit = license_scan._TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, "text\nReleased under the MIT Licence.\nmore"), (3, mit + " extra"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}
    assert license_scan.scan_licenses(odd).count() == len(ODD)


def test_whole_licenses(spark):
    isc = """ISC License

Copyright Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + textwrap.fill(license_scan._ISC_END, 76)
    texts = [("ISC", isc), *[(x, (license_scan.WHOLE_TEXTS / f"{x}.txt").read_text()) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0")]]
    apache = (license_scan.WHOLE_TEXTS / "Apache-2.0.txt").read_text()
    texts += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2021 Some One")), ("Apache-2.0", apache[: apache.index("APPENDIX")])]
    texts += [(x, textwrap.fill(t, w)) for w in (60, 79) for x, t in [("BSD-3-Clause", license_scan._BSD.format("1.", "2.", license_scan._BSD_NAME.format("3.", "copyright holder"), "COPYRIGHT HOLDERS", "COPYRIGHT OWNER"))]]
    texts += [("BSD-2-Clause", "Copyright (c) 2011, Some One\nAll rights reserved.\n\n" + textwrap.fill(license_scan._BSD.format("*", "*", "", "COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), 70))]
    texts += [(None, apache + "\nand more"), (None, "(c) the third item\n" + isc)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [x for x, _ in texts]


def test_html(spark):
    page = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy now, cheap, today, really good offer</div>
    <div id="main"><h1>Title &amp; more</h1><p>First&nbsp;paragraph, with some commas, and   enough words to count.<p>Second <b>bold</b> one, which is<br>also long enough, as text.<ul><li>item one<li>item two</ul></div>
    <div class="comments"><p>Great post, thanks, I liked it, very much so, indeed.</p></div><form>name <input></form><footer>© x</footer></body></html>"""
    want = "Title & more\n\nFirst paragraph, with some commas, and enough words to count.\n\nSecond bold one, which is also long enough, as text.\n\nitem one\n\nitem two"
    assert html_text.extract(page) == want
    assert html_text.extract("") == html_text.extract(None) == "" and html_text.extract("plain text") == "plain text"
    assert html_text.extract("<div>" * 3000 + "<p>deep, down, here, with a lot of words in it</p>") == "deep, down, here, with a lot of words in it"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract_pages(pages).collect()} == {1: len(want), 2: 0}


@pytest.mark.parametrize("n", [5, 50])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_html_nested_body(n, tag):
    """A long article keeps what a short one does."""
    prose = [f"Paragraph {k}, with some commas, and enough words in it to be counted as a sentence of prose, {'more words ' * 20}end." for k in range(n)]
    inner = "<div class=body>" + "".join(f"<p>{x}</p>" for x in prose) + "</div>"
    rest = "<h2>Short part</h2><ul><li>one<li>two</ul><pre>code()</pre><table><tr><td>cell</td></tr></table><blockquote>said</blockquote>"
    page = f"<body><nav><a href=x>Menu</a></nav><{tag}><h1>Title</h1>{inner}{rest}</{tag}><div><a href=y>Other pages</a></div></body>"
    assert html_text.extract(page).split("\n\n") == ["Title", *prose, "Short part", "one", "two", "code()", "cell", "said"]


def test_html_odd(spark):
    prose = "A paragraph, with commas, and words enough that it is taken for prose and not for a heading or a link."
    assert html_text.extract(f"<article><p>{prose} <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>TeX</annotation></math></p></article>") == prose + " E=mc2"
    assert html_text.extract(f"<article><p>{prose}</p><p><a href=\"never closed>{prose}</a></p></article>") == f"{prose}\n\n{prose}"
    assert html_text.extract(f"<article><p>{prose}</p></span></b></section><ul><li>a<p>b</p><li>c</ul></article>") == f"{prose}\n\na\n\nb\n\nc"
    began = time.monotonic()
    for stray in ("</span>", "</b>", "<p>x", "<li>"):
        html_text.extract("<b>" + "<div>" * 16_000 + stray * 16_000 + f"<p>{prose}</p>")
        html_text.extract("<p>" + "<b>" * 16_000 + (stray + "<i>") * 16_000 + f"<p>{prose}</p>")
    assert time.monotonic() - began < 30
    pages = spark.createDataFrame([(1, "u", prose, "clash", 1), (1, "u", prose, "clash", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract_pages(pages).collect()] == [(1, "u", prose, len(prose))] * 2
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_kneser_ney(spark, odd, corpus):
    rows = [(i, t) for i, t, *_ in corpus[1]]
    docs = corpus[0].select("doc_id", "text")
    train = docs.filter(~kneser_ney.held_out(F.col("doc_id")))
    model = kneser_ney.fit(train.select("text"))
    import zlib

    words = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    seen = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 10]
    three = lambda w: list(zip([0, 0, *w[:-2]][: len(w)], [0, *w[:-1]], w))
    count = collections.Counter(x for w in seen for x in w)
    triple = collections.Counter(t for w in seen for t in three(w))
    pair = collections.Counter()  # distinct predecessors; occurrences at a text's start
    for (_, v, w), c in triple.items():
        pair[v, w] += c if v == 0 else 1
    single = collections.Counter(w for _, w in pair)

    def order(counts, lower):
        """p of an order from its counts, as a function of a context and a word."""
        d = [0, *kneser_ney.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])]
        total, after = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0])
        for (*u, _), c in counts.items():
            total[tuple(u)] += c
            after[tuple(u)][min(c, 3)] += 1

        def p(u, w):
            c = counts[(*u, w)]
            rest = sum(d[k] * after[u][k] for k in (1, 2, 3))
            return (max(c - d[min(c, 3)], 0) + rest * lower(u[1:], w)) / total[u] if total[u] else lower(u[1:], w)

        return p

    e = [0, *kneser_ney.discounts([sum(c == k for c in single.values()) for k in (1, 2, 3, 4)])]
    types = sum(single.values())
    left = sum(e[min(c, 3)] for c in single.values()) / types
    lowest = lambda _, w: max(single[w] - e[min(single[w], 3)], 0) / types + left / (len(count) + 1)
    p = order(triple, order(pair, lowest))
    for u in ((0, 0), (0, seen[0][0]), (seen[0][0], seen[0][1])):
        assert sum(p(u, w) for w in count) + p(u, "unknown!") == pytest.approx(1)
    for r in kneser_ney.score_documents(docs, model).collect():
        w = words[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(t[:2], t[2])) for t in three(w)), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[v] > 0 for v in w), sum(count.values()))
    assert kneser_ney.score_documents(odd, model).count() == len(ODD)
    for below, values in ((36, np.arange(2000)), (60, np.arange(2000) * 997 + 3)):  # columns of one byte keep what is larger
        keys = np.unique(np.random.default_rng(1).integers(0, 2**below, 2000, dtype=np.uint64))
        keys = np.unique(np.concatenate((keys[:1500], keys[:400] + np.uint64(1))))  # keys that are found in one place
        shard = shared_arrays.HashedShard(shared_arrays.shard_file(keys, [values[: len(keys)]], below), 1, below)
        place, hit = shard.find(np.append(keys, np.uint64(77)))
        assert hit[:-1].all() and not hit[-1] and (shard.values(0, place[:-1]) == values[: len(keys)]).all()
    empty = kneser_ney.fit(docs.limit(0).select("text"))
    assert {r["score"] for r in kneser_ney.score_documents(odd.filter("doc_id = 1"), empty).collect()} == {0.0}


def test_vantage_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[500:620] = x[500]
    rows = [(i, x[i].tolist()) for i in range(900)] + [(901, None), (902, [0.0] * 12), (903, [float("nan")] * 12), (None, x[0].tolist()), (904, [1.0, 2.0]), (10, x[10].tolist())]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vptree.nearest(data, data.filter("vec_id % 50 = 0"), shard=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    for i in range(0, 900, 50):
        c = unit @ unit[i]
        want = sorted((j for j in range(900) if j != i), key=lambda j: (-round(c[j], 12), j))[:5]
        assert [j for j, _ in got[i]] == want and np.allclose([s for _, s in got[i]], c[want])
    few = vptree.nearest(data, data.filter("vec_id % 50 = 0"), shard=200, turn=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in few] == [(q, i, s) for q in sorted(got) for i, s in got[q]]
    assert vptree.nearest(data.limit(0), data.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (50, [0.0, 1.0])], "vec_id bigint, embedding array<double>").withColumn("score", F.lit(9)).withColumn("shard", F.lit("x"))
    assert [(r["vec_id"], r["score"]) for r in vptree.nearest(twice, twice.filter("vec_id = 50")).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    tree = vptree.VantageTree(unit, leaf=16)
    exact = tree.search(unit[:50], 5)[0]
    loose = tree.search(unit[:50], 5, 1.5)[0]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, loose)]) > 0.6


@pytest.mark.parametrize("kind", ["signs", "one-hot", "scaled"])
def test_vantage_trees_ties(spark, kind):
    """Vectors with very many equal cosines: all rows are those of brute force."""
    rng = np.random.default_rng(6)
    x = {"signs": rng.choice([-1.0, 1.0], (400, 6)), "one-hot": np.eye(8)[rng.integers(0, 8, 400)], "scaled": np.eye(3)[rng.integers(0, 3, 400)] * rng.integers(1, 60, (400, 1))}[kind]
    data = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vptree.nearest(data, data.filter("vec_id % 50 = 0"), shard=90).collect()}
    for q in range(0, 400, 50):
        c = vptree._cosine(np.repeat(x[q : q + 1], 400, 0), x)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-c[i], i))[:5]
        assert [got[q, k] for k in range(1, 6)] == want


def test_vantage_trees_scaled_copies(spark):
    """Many vectors of one direction: the smallest ids are the nearest, wherever they lie in the tree."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, size=(400, 8)).astype(np.float64)
    order = rng.permutation(40)
    rows = [(i, (x[0] * 2.0 ** int(order[i])).tolist()) for i in range(40)] + [(i, x[i].tolist()) for i in range(40, 400)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vptree.nearest(data, data.filter("vec_id in (20, 39)"), shard=1000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {20: [0, 1, 2, 3, 4], 39: [0, 1, 2, 3, 4]}


def test_bpe_makes_room_without_changing_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "WORD_CACHE", 6)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.BacktrackingBPE(open(path, encoding="utf-8").read())
    texts = ["the cat, the hat", "xqzzv***the un-think<|endoftext|>able 42", "été ß the\u3000cat", "", "the cat's overoverover the"] * 4
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert "the" in own._key and len(own._key) <= 6 + 12


def test_long_texts(spark, odd, monkeypatch):
    """Operators that work through a long text in parts give what they give for the whole of it."""
    from evidentia.llm import kernels

    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b bb", "Ünï", "ccc ccc", "x" * 40, "<|endoftext|>", "don't", "\n", "\u0301e"]) for _ in range(n)) for n in (300, 1, 50)] + ["", "y" * 90, " z" * 60]
    raw, cuts = b"".join(t.encode() for t in texts), np.cumsum([0, *(len(t.encode()) for t in texts)])
    raw = np.frombuffer(raw, np.uint8)
    two = spark.createDataFrame([(0, texts[0], "a"), (1, texts[1], "b")], "doc_id bigint, text string, lang string")
    net, classifier = quality_net.ByteConvNet(), mixing.fit_classifier(two, two.select("doc_id"))
    own = bpe.BacktrackingBPE(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    model = kneser_ney.fit(docs.select("text"))
    alone = lambda f: [f(raw[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:])]
    jobs = {
        "words": lambda: kernels.word_spans(raw, cuts, True),
        "posterior": lambda: classifier.posteriors(raw, cuts),
        "net": lambda: np.concatenate(alone(net.pooled)),
        "kneser_ney": lambda: np.stack([np.stack(x) for x in alone(kneser_ney.KneserNey(model).score)]),
        "kneser_ney_all": lambda: np.stack(kneser_ney.KneserNey(model).score(raw, cuts)),
        "digests": lambda: [own.digest_long(t) for t in texts],
        "runs": lambda: [np.sort(np.concatenate([r[k] for r in kneser_ney._runs(iter([pa.record_batch([pa.array(texts)], ["t"])]))])) for k in (0, 2)],
    }
    want = {k: f() for k, f in jobs.items()}
    ids, at = own.encode_many(texts)
    one, two = own.digests(ids, at)
    assert want["digests"] == list(zip(np.diff(at).tolist(), one, two))
    assert np.allclose(np.concatenate(want["kneser_ney"], axis=1), want["kneser_ney_all"])
    for module, name, value in ((kernels, "PIECE", 7), (quality_net, "LONG", 100), (quality_net, "AT_ONCE", 2), (bpe, "LONG", 50), (bpe, "PART", 3), (kneser_ney, "RUN", 11)):
        monkeypatch.setattr(module, name, value)
    for k, f in jobs.items():
        got = f()
        if k == "digests":
            assert got == want[k]
        else:
            assert all(np.allclose(x, y) for x, y in zip(got, want[k], strict=True)), k
    trie = token_counts.UnigramTrie(token_counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model")))
    words = ["".join(rng.choice("theandinger漢é") for _ in range(n)) for n in (1, 5, 40, 300)]
    assert [trie._walk(token_counts.MARK + w) for w in words] == [trie.count(w) for w in words]


def test_network_sample(spark):
    """The sample is of the labelled rows of the documents, long ones too."""
    text = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(i, text if i % 2 else "### " * 9000, "en", "s", 0) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(-5000, 60)], "doc_id bigint, quality int, toxic int")
    net = quality_net.fit_network(docs, labels, sample=30)
    assert net.constant is None
    rows = quality_net.quality_scores(docs, net).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)
    assert quality_net.quality_scores(docs.limit(0), net).count() == 0
