"""A page is searched once, however many tables are made of what is found."""

from evidentia.operators.extract_paper import paper_evidence


def test_matches_are_kept_for_all_branches(spark):
    pages = spark.createDataFrame([("p", 1, "We use a batch size of 32 here.", 0)], "paper_id string, page_no int, text string, n_images int")
    out = paper_evidence(pages)
    assert out["hits"].storageLevel.useDisk
    plan = out["evidence"]._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    assert [(r["key"], r["raw_value"]) for r in out["evidence"].collect()] == [("batch_size", "32")]
    out["hits"].unpersist()
