"""Tables from laid-out words: rows, cells and columns from coordinates, by gaps and islands in the words of whole pages.

* Rows are islands of words whose heights overlap.
* Cells are islands of words of a row that stand no further apart than ``WORD_GAP`` of the row's height.
* A table is a run of rows no further apart than ``ROW_GAP`` of their height, of two cells each or more; a row of one cell belongs to it
  if both its neighbours have more.
* A cell that overlaps two cells of the row above or below is a merged one. Columns are islands of all other cells of a table, so that a column
  that only its head fills is one too. A merged cell counts for the first column that it reaches.

The words of a page become one row, which a task holds by itself; workers take many pages at once and work on arrays: neither a word nor a page costs
a call of its own.
Not-a-number is the greatest number and equals itself, as in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of a word's height that may lie within the row above; shares of a row's height between words of a cell, and between rows of a table.
INTO, WORD_GAP, ROW_GAP = 0.3, 0.6, 2.5
PAGE = ("paper_id", "page_no")
BOX = ("x0", "y0", "x1", "y1")
#: Words that a worker takes at once, but for longer pages.
WORDS = 50_000


def _gt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _ge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a >= b) | np.isnan(a)


def _ranks(*values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the distinct values in order, the places of each array's values among them)."""
    distinct, places = np.unique(np.concatenate(values), return_inverse=True)
    return distinct, np.split(places.astype(np.int64), np.cumsum([len(v) for v in values])[:-1])


def _before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The greatest value of the rows before in the same group, of no meaning for its first. Groups are numbered upwards."""
    distinct, (place,) = _ranks(values)
    most = np.maximum.accumulate(group * len(distinct) + place)
    return np.concatenate([[np.nan], distinct[most[:-1] % len(distinct)]])


def _starts(group: np.ndarray) -> np.ndarray:
    """Where the groups begin in an array of ascending numbers."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _joined(texts: pa.Array, starts: np.ndarray) -> pa.Array:
    """The texts from each start to the next one, with spaces between."""
    if len(starts) == len(texts):
        return texts
    offsets = pa.array(np.append(starts, len(texts)).astype(np.int32), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), " ")


def _shifted(values: np.ndarray, page: np.ndarray, by: int, none: object) -> np.ndarray:
    """The value of the row before (1) or after (-1) on the same page, else ``none``."""
    out = np.full(len(values), none, values.dtype)
    same = page[1:] == page[:-1]
    if by > 0:
        out[1:][same] = values[:-1][same]
    else:
        out[:-1][same] = values[1:][same]
    return out


def _overlaps(cells: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many cells of the row ``of`` each cell overlaps; rows below 0 have none. The cells of a row stand apart, in order."""
    distinct, (x0, x1) = _ranks(cells["x0"], cells["x1"])
    key = lambda row, x: row * len(distinct) + x
    row = cells["row"]
    begun = np.searchsorted(key(row, x0), key(of, x1), "left")
    # a cell without an end in a row's midst leaves the ends out of order: those who stand beside that row look at each of its cells
    apart = np.flatnonzero((x1[1:] < x1[:-1]) & (row[1:] == row[:-1]))
    ended = np.searchsorted(np.maximum.accumulate(key(row, x1)), key(of, x0), "right")
    found = np.where(of >= 0, begun - ended, 0)
    for at in np.flatnonzero(np.isin(of, row[apart])) if len(apart) else ():
        its = slice(starts[of[at]], ends[of[at]])
        found[at] = np.count_nonzero((x0[its] < x1[at]) & (x1[its] > x0[at]))
    return found


def _tables(pages: pa.RecordBatch) -> pa.RecordBatch | None:
    """The cells of the tables of pages, one a row, with lists of what their words have."""
    x0, y0, x1, y1 = (pages.column(c).flatten().to_numpy() for c in BOX)
    page = np.repeat(np.arange(pages.num_rows), pc.list_value_length(pages.column("word")).to_numpy())
    first = np.concatenate([[True], page[1:] != page[:-1]])
    down = np.lexsort((y1, x0, y0, page))
    x0, y0, x1, y1 = (v[down] for v in (x0, y0, x1, y1))
    # rows
    breaks = first | _ge(y0 + INTO * (y1 - y0), _before(y1, page))
    row = np.cumsum(breaks) - 1
    of_row = np.flatnonzero(breaks)
    row_page, top, bottom = page[of_row], np.fmin.reduceat(y0, of_row), np.maximum.reduceat(y1, of_row)
    # cells
    across = np.lexsort((x1, x0, row))
    x0, x1, in_row = x0[across], x1[across], row[across]
    breaks = _gt(x0 - _before(x1, in_row), WORD_GAP * (bottom - top)[in_row])
    breaks[of_row] = True
    text = pc.take(pages.column("word").flatten(), pa.array(down[across]))
    text = _by_word(text, (x0[1:] == x0[:-1]) & ~_gt(x1[1:], x1[:-1]) & (in_row[1:] == in_row[:-1]))
    of_cell = np.flatnonzero(breaks)
    cells = {"row": in_row[of_cell], "x0": x0[of_cell], "x1": np.maximum.reduceat(x1, of_cell)}
    text = _joined(text, of_cell)
    # tables
    n = np.bincount(cells["row"], minlength=len(of_row))
    near = ~_gt(top - _shifted(bottom, row_page, 1, np.nan), ROW_GAP * (bottom - top)) & (_shifted(row_page, row_page, 1, -1) >= 0)
    between = near & _shifted(near, row_page, -1, False) & (_shifted(n, row_page, 1, 0) > 1) & (_shifted(n, row_page, -1, 0) > 1)
    inside = (n > 1) | between
    begins = inside & ~(near & _shifted(inside, row_page, 1, False))
    table = np.cumsum(begins) - 1
    size = np.bincount(table[inside], minlength=max(int(begins.sum()), 1))
    # one row is a line of text, not a table
    keep = inside & (size[table] > 1)
    if not keep.any():
        return None
    here = keep[cells["row"]]
    kept = np.cumsum(keep) - 1
    table, row_page = table[keep], row_page[keep]
    of_table = _starts(table)
    table = np.cumsum(np.concatenate([[False], table[1:] != table[:-1]]))
    row_no = np.arange(len(table)) - of_table[table]
    # tables are numbered within their page
    table_page = row_page[of_table]
    of_page = _starts(table_page)
    table_no = np.arange(len(of_table)) - np.repeat(of_page, np.diff(np.append(of_page, len(of_table))))
    cells = {"row": kept[cells["row"][here]], "x0": cells["x0"][here], "x1": cells["x1"][here]}
    text = text.filter(pa.array(here))
    # merged cells
    starts = _starts(cells["row"])
    ends = np.append(starts[1:], len(cells["row"]))
    above = np.where(row_no > 0, np.arange(len(table)) - 1, -1)
    below = np.where(np.append(table[1:] == table[:-1], False), np.arange(len(table)) + 1, -1)
    plain = (_overlaps(cells, starts, ends, above[cells["row"]]) < 2) & (_overlaps(cells, starts, ends, below[cells["row"]]) < 2)
    # columns
    in_table = table[cells["row"]]
    order = np.flatnonzero(plain)
    order = order[np.lexsort((cells["x1"][order], cells["x0"][order], in_table[order]))]
    distinct, (x0, x1) = _ranks(cells["x0"], cells["x1"])
    key = lambda x: in_table * len(distinct) + x
    c0, c1 = key(x0)[order], np.maximum.accumulate(key(x1)[order]) if len(order) else order
    begin = np.ones(len(order), bool)
    begin[1:] = c0[1:] >= c1[:-1]  # the first of a table lies beyond all of the tables before
    of_column = np.flatnonzero(begin)
    c0, c1 = c0[of_column], (c1[np.append(of_column[1:], len(order)) - 1] if len(order) else c1)
    before = np.searchsorted(c0, in_table * len(distinct), "left")
    left, reached = np.searchsorted(c1, key(x0), "right"), np.searchsorted(c0, key(x1), "left")
    col_no, span = left - before, np.maximum(reached - left, 1)
    # cells of a row that lie in one column are one
    of_place = np.flatnonzero(np.concatenate([[True], (cells["row"][1:] != cells["row"][:-1]) | (col_no[1:] != col_no[:-1])]))
    rows = cells["row"][of_place]
    at = pa.array(row_page[rows])
    ints = lambda v: pa.array(v.astype(np.int32), pa.int32())
    columns = [pc.take(pages.column(c), at) for c in PAGE]
    columns += [ints(table_no[table[rows]]), ints(row_no[rows]), ints(col_no[of_place]), _joined(text, of_place), ints(np.maximum.reduceat(span, of_place))]
    return pa.RecordBatch.from_arrays(columns, names=[*PAGE, "table_no", "row_no", "col_no", "cell", "span"])


def _by_word(text: pa.Array, same: np.ndarray) -> pa.Array:
    """Words in the same place in their own order; ``same`` says of each but the first that it lies where the one before does."""
    if not same.any():
        return text
    words = text.to_pylist()
    ties = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in ties.reshape(-1, 2):
        words[a : b + 1] = sorted(words[a : b + 1])
    return pa.array(words, text.type)


def _in_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of pages, of some ``WORDS`` words at once."""
    for batch in batches:
        ends, begin = np.cumsum(pc.list_value_length(batch.column("word")).to_numpy()), 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WORDS, "right"))
            end = max(end, begin + 1)
            if (out := _tables(batch.slice(begin, end - begin))) is not None:
                yield out
            begin = end


def table_cells(words: DataFrame) -> DataFrame:
    """Cells of tables (the columns of TABLE_CELLS) and ``span``, the number of columns that a cell reaches over, of words (paper_id, page_no, x0, y0,
    x1, y1, word). Words that are null or blank, or whose box is null or empty, take no part. Words are shuffled at most once, by page."""
    seen = words.filter("trim(word) <> '' and x1 > x0 and y1 > y0").select(*PAGE, *[F.col(c).cast("double").alias(c) for c in BOX], F.trim("word").alias("word"))
    types = {f.name: f.dataType.simpleString() for f in words.schema}
    told = ", ".join([*[f"{c} {types[c]}" for c in PAGE], "table_no int", "row_no int", "col_no int", "cell string", "span int"])
    # none of the five is null, so that the lists of a page are in step
    return seen.groupBy(*PAGE).agg(*[F.collect_list(c).alias(c) for c in (*BOX, "word")]).mapInArrow(_in_turns, told)
