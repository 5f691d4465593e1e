"""Tables from word boxes against a plain sweep over each page, with merged cells, heads without values, and odd boxes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evidentia.operators.extract_paper import table_claims
from evidentia.operators.layout import INTO, ROW_GAP, WORD_GAP, table_cells

WORDS = "paper_id string, page_no int, x0 double, y0 double, x1 double, y1 double, word string"


def brute(words):
    """Rows, cells, tables and columns of one page by loops."""
    words = [w for w in words if w[4] and w[4].strip() and None not in w[:4] and w[2] > w[0] and w[3] > w[1]]
    words = sorted(((x0, y0, x1, y1, w.strip()) for x0, y0, x1, y1, w in words), key=lambda w: (w[1], w[0], w[3], w[4]))
    rows, bottom = [], None
    for w in words:
        if bottom is None or w[1] + INTO * (w[3] - w[1]) >= bottom:
            rows.append([])
        rows[-1].append(w)
        bottom = max(w[3], bottom if bottom is not None else w[3])
    laid = []
    for row in rows:
        height, cells, end = max(w[3] for w in row) - min(w[1] for w in row), [], None
        for w in sorted(row, key=lambda w: (w[0], w[2], w[4])):
            if end is None or w[0] - end > WORD_GAP * height:
                cells.append([w[0], w[2], []])
            cells[-1][1], end = max(cells[-1][1], w[2]), max(w[2], end if end is not None else w[2])
            cells[-1][2].append(w[4])
        laid.append((min(w[1] for w in row), max(w[3] for w in row), [(a, b, " ".join(t)) for a, b, t in cells]))
    near = [False] + [b[0] - a[1] <= ROW_GAP * (b[1] - b[0]) for a, b in zip(laid, laid[1:])]
    many = [len(c) > 1 for _, _, c in laid]
    inside = [many[i] or (0 < i < len(laid) - 1 and near[i] and near[i + 1] and many[i - 1] and many[i + 1]) for i in range(len(laid))]
    tables = []
    for i, row in enumerate(laid):
        if inside[i]:
            if not (near[i] and inside[i - 1] and i):
                tables.append([])
            tables[-1].append(row[2])
    out = []
    for t, table in enumerate(x for x in tables if len(x) > 1):
        over = lambda a, b: a[0] < b[1] and b[0] < a[1]
        merged = lambda r, c: any(sum(over(c, d) for d in table[s]) > 1 for s in (r - 1, r + 1) if 0 <= s < len(table))
        columns = []
        for a, b in sorted((c[0], c[1]) for r, row in enumerate(table) for c in row if not merged(r, c)):
            if columns and a < columns[-1][1]:
                columns[-1][1] = max(columns[-1][1], b)
            else:
                columns.append([a, b])
        for r, row in enumerate(table):
            found = {}
            for c in row:
                reach = [k for k, x in enumerate(columns) if over(c, x)]
                found.setdefault(reach[0] if reach else sum(x[1] <= c[0] for x in columns), []).append((c[2], max(len(reach), 1)))
            out += [(t, r, k, " ".join(x for x, _ in v), max(s for _, s in v)) for k, v in found.items()]
    return sorted(out)


def page(rng):
    """Random tables between lines of text: jittered boxes, merged and empty cells."""
    words, y = [], 10.0
    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(0, 3)):
            x = 5.0
            for _ in range(rng.randint(3, 9)):
                words.append((x, y, x + 20, y + 10, "text"))
                x += 23
            y += 14
        y += rng.choice([4, 40])
        columns = rng.randint(2, 5)
        for r in range(rng.randint(1, 6)):
            k = 0
            while k < columns:
                span = rng.choice([1, 1, 1, 1, 2, columns]) if r < 2 else rng.choice([1, 1, 1, 1, 1, 2])
                if rng.random() < 0.85:
                    x = k * 80 + rng.uniform(0, 8)
                    for _ in range(rng.randint(1, 2) if span == 1 else 3 * min(span, columns - k)):
                        width = rng.uniform(10, 28)
                        words.append((x, y + rng.uniform(0, 2), x + width, y + 9 + rng.uniform(0, 2), f"w{rng.randrange(99)}"))
                        x += width + 3
                k += span
            y += rng.choice([13, 13, 15, 60])
    words += [(1.0, 1.0, 1.0, 5.0, "empty"), (None, 1.0, 2.0, 3.0, "null"), (1.0, 1.0, 9.0, 5.0, "  "), (1.0, 1.0, 9.0, 5.0, None)]
    rng.shuffle(words)
    return words


def test_pages_of_random_tables(spark):
    rng = random.Random(6)
    pages = [page(rng) for _ in range(150)]
    rows = [(f"p{i // 10}", i % 10, *w) for i, ws in enumerate(pages) for w in ws]
    got = {}
    for r in table_cells(spark.createDataFrame(rows, WORDS).repartition(5)).collect():
        got.setdefault((r["paper_id"], r["page_no"]), []).append((r["table_no"], r["row_no"], r["col_no"], r["cell"], r["span"]))
    want = {(f"p{i // 10}", i % 10): cells for i, ws in enumerate(pages) if (cells := brute(ws))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(c[4] > 1 for v in want.values() for c in v) > 50
    assert table_cells(spark.createDataFrame([], WORDS)).count() == 0


def test_cells_give_claims(spark):
    text = [["Training configuration of the final model", None, None], ["Parameter", "Value", "Note"], ["batch size", "64", None], ["dropout", "0.3", "fixed"], ["momentum", "0.9", None]]
    rows = []
    for r, line in enumerate(text):
        for k, cell in enumerate(line):
            x = 10.0 + 120 * k
            for word in (cell or "").split():
                rows.append(("p", 1, x, 20.0 * r, x + 5 * len(word), 20.0 * r + 10, word))
                x += 5 * len(word) + 4
    cells = table_cells(spark.createDataFrame(rows, WORDS))
    assert {(r["row_no"], r["col_no"]): r["cell"] for r in cells.filter("row_no < 2").collect()} == {(0, 0): "Parameter", (0, 1): "Value", (0, 2): "Note", (1, 0): "batch size", (1, 1): "64"}
    found = table_claims(cells.withColumn("row_no", F.col("row_no")))
    assert {(r["key"], r["raw_value"]) for r in found.collect()} == {("batch_size", "64"), ("dropout", "0.3"), ("momentum", "0.9")}
