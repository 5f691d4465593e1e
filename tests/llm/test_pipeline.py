"""The pipeline and each of its stages, on a small corpus with planted copies and junk, and on odd and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def rows():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(240):
        bad = i % 5 == 4
        text = " ".join(rng.choice(vocab) + ("###" if bad else "") for _ in range(rng.randint(60, 120)))
        docs.append((i, text, "en" if i % 3 else "de", "s", 0))
        labels.append((i, int(not bad), 0))
    copies = [(1000 + k, docs[k * 5][1], "en", "s", 0) for k in range(8)]  # exact copies of good documents
    words = docs[10][1].split()
    near = [(2000 + k, " ".join([*words[:-1], f"end{k}"]), "en", "s", 0) for k in range(3)]  # one word of many differs
    return docs + copies + near, labels


ODD = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "two words", "en", "s", 0), (None, "no id here", "en", "s", 0), (9004, "x " * 4000, "en", "s", 0), (9004, "x " * 4000, "en", "s", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs, labels = rows()
    spark.createDataFrame(docs + ODD, DOCS).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def test_run(spark, folder):
    """Junk goes, one of each group of copies stays, clean documents stay, and what stays is encoded whole."""
    from tokenizers import Tokenizer

    docs, _ = rows()
    got = corpus_pipeline.run(spark, folder).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    clean = {d[0] for d in docs if d[0] < 1000 and d[0] % 5 != 4}
    assert not {i for i in ids if i is not None and 1000 <= i < 9000} and not {i for i in ids if i is not None and i < 1000 and i % 5 == 4}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        if r["doc_id"] in texts:
            found = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(found) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
    # mixing may repeat and drop documents, but before it all clean ones are there
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, folder)
        assert table.columns == [c.split()[0] for c in DOCS.split(", ")], name
    left = {r["doc_id"] for r in table.select("doc_id").collect()}
    assert len(clean - left) <= 0.02 * len(clean)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, folder, name):
    """Each stage by itself: nulls, empty texts, repeated rows, another column, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash"))
    found = stage(spark, odd, folder)
    if name == "bpe":
        assert found.count() == len(ODD) and found.filter("n_tokens = 0").count() == 2
    else:
        assert found.columns == odd.columns
        kept = collections.Counter(r["doc_id"] for r in found.collect())
        want = {"quality_rules": {}, "near_duplicates": {9001: 1, 9002: 1, 9003: 1, None: 1, 9004: 1}}.get(name)
        assert want is None or kept == want
    empty = stage(spark, odd.limit(0), folder)
    assert empty.count() == 0 and (name == "bpe" or empty.columns == odd.columns)
