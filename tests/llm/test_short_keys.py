"""Operator 9 where many n-grams share a short key."""

import collections
import math
import zlib

from pyspark.sql import functions as F

from evidentia.llm import kneser_ney


def test_shared_keys_leave_counts_exact_and_scores_finite(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BELOW", 10)  # 14 bits in all
    words = lambda i: [f"w{(i * 7919 + j * j * 31 + j * i) % 1500}" for j in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words(i))) for i in range(300)], "doc_id bigint, text string").repartition(2)
    rows = kneser_ney.score_documents(docs, kneser_ney.fit(docs.filter(~kneser_ney.held_out(F.col("doc_id"))).select("text"))).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(w for i in range(300) if not held(i) for w in [*words(i), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        tokens = [*words(r["doc_id"]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), 61, sum(w in count for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-12)
        assert math.isfinite(r["score"])
    assert len(rows) == 300
