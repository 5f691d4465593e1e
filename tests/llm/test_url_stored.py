"""Operator 12 with more grams than are sent to workers."""

from evidentia.llm import url_models

from .test_phrases_urls_variants import pages, urls


def test_stored_models_keep_every_gram(spark):
    rows = pages(spark, urls(300)).repartition(3)
    few = {tuple(r) for r in url_models.judge_urls(rows, sent=100).collect()}
    assert few == {tuple(r) for r in url_models.judge_urls(rows).collect()} and len(few) == len({r[:5] for r in few})
    assert any(r[5] for r in few)
    texts = rows.filter("url is not null").selectExpr("url as text", "page_id % 2 = 0 as blocked")
    whole, stored = url_models.fit(texts), url_models.fit(texts, sent=100)
    assert isinstance(stored, url_models.Stored) and len(whole.grams) > 100
    score = lambda m: sorted(tuple(r) for r in url_models.scored(texts, m).select("text", "score").collect())
    assert score(whole) == score(stored)
