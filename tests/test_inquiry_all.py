"""Questions about everything that is in conflict or does not parse."""

from evidentia.operators import inquiry


def test_no_bound_asks_about_all(spark):
    found = spark.range(9).selectExpr("'a' as audit_id", "concat('k', id) as key", "id as seq", "'inconsistent' as status", "if(id % 2 = 0, 'high', 'medium') as risk", "named_struct('raw_value', '1') as paper", "named_struct('raw_value', '2') as code")
    none = spark.createDataFrame([], "audit_id string, key string")
    failed = spark.range(8).selectExpr("'a' as audit_id", "concat('f', id) as file", "'r' as reason")
    count = lambda *more: {r["kind"]: r["n"] for r in inquiry.summarize(inquiry.build_questions(found, none, none, failed, *more)).collect()}
    assert count() == {"conflict": 5, "parse_failure": 5}
    assert count(None, None, ("high", "medium")) == {"conflict": 9, "parse_failure": 8}
