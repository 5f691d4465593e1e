"""Tables from word boxes shuffle the words once."""

import pyarrow as pa

from evidentia.operators import layout
from evidentia.operators.layout import table_cells


def test_words_are_shuffled_once(spark):
    words = spark.range(8).selectExpr("concat('p', id div 8) as paper_id", "cast(id div 8 as int) as page_no", "10d + 150 * (id % 2) as x0", "20d * (id div 2) as y0", "40d + 150 * (id % 2) as x1", "20d * (id div 2) + 10 as y1", "concat('w', id) as word")
    cells = table_cells(words)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r["row_no"], r["col_no"], r["cell"], r["span"]) for r in cells.collect()) == [(i // 2, i % 2, f"w{i}", 1) for i in range(8)]


def test_pages_without_windows_in_turns(spark, monkeypatch):
    """No window sorts the words; pages come out whole from batches of some pages, from turns of some words, and without a name."""
    words = spark.range(600).selectExpr("nullif(concat('p', id div 60), 'p3') as paper_id", "cast(id div 30 % 2 as int) as page_no", "10d + 150 * (id % 2) as x0", "20d * (id % 30 div 2) as y0", "40d + 150 * (id % 2) as x1", "20d * (id % 30 div 2) + 10 as y1", "concat('w', id) as word")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cells = table_cells(words)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
        rows = cells.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(None if i // 60 == 3 else f"p{i // 60}", i // 30 % 2, 0, i % 30 // 2, i % 2, f"w{i}", 1) for i in range(600)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    # turns of one page, and of all
    columns = [pa.array(["p", None, "q"]), pa.array([1, 1, 2], pa.int32()), *[pa.array([v] * 3) for v in ([10.0, 160.0] * 2, [0.0, 0.0, 20.0, 20.0], [40.0, 190.0] * 2, [10.0, 10.0, 30.0, 30.0], list("abcd"))]]
    batch = pa.RecordBatch.from_arrays(columns, names=[*layout.PAGE, *layout.BOX, "word"])
    (whole,) = layout._in_turns([batch])
    monkeypatch.setattr(layout, "WORDS", 3)
    assert pa.Table.from_batches(layout._in_turns([batch.slice(0, 2), batch.slice(2)])).to_pylist() == whole.to_pylist() and whole.num_rows == 12


def test_boxes_without_an_end(spark):
    """Not-a-number is the greatest: such a box has no end to its right, and takes part."""
    nan, inf = float("nan"), float("inf")
    boxes = [(10.0, 0.0, nan, 10.0, "a"), (200.0, 0.0, 240.0, 10.0, "b"), (10.0, 20.0, 40.0, 30.0, "c"), (60.0, 20.0, 90.0, 30.0, "x"), (200.0, 20.0, inf, 30.0, "d"), (200.0, 20.0, inf, 30.0, "D")]
    rows = table_cells(spark.createDataFrame([("p", 1, *b) for b in boxes], "paper_id string, page_no int, x0 double, y0 double, x1 double, y1 double, word string")).collect()
    assert sorted((r["row_no"], r["col_no"], r["cell"], r["span"]) for r in rows) == [(0, 0, "a", 3), (0, 2, "b", 1), (1, 0, "c", 1), (1, 1, "x", 1), (1, 2, "D d", 1)]
