"""Tables from word boxes, alignment of line lists and code of other languages, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import layout, lines
from ..operators.extract_code import multilang_evidence
from .align import table
from .audits import _parts, _text


#: A word of a page: where it stands, whether it is jittered to the right and down and moves down with its line, and the word or the column that has it.
_WORD = "dx int, dy int, right boolean, down boolean, by_line boolean, given string, of string"


def _laid(x: int, y: int, *words: str, right: bool = True, down: bool = True, by_line: bool = False) -> list[Column]:
    """Words from (x, y) on, of six units a letter and four between words; ``:c`` stands for the word that the column c has, and is the last."""
    placed = []
    for word in words:
        fields = (x, y, right, down, by_line, None if word[0] == ":" else word, word[1:] if word[0] == ":" else None)
        placed.append(F.struct(*[F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(fields, _WORD.split(", "), strict=True)]))
        x += len(word) * 6 + 4
    return placed


def boxed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders laid out as tables, jittered, with a merged head over two columns and a column that only some rows fill, between lines of prose."""
    # by paper, so that the words of its page need not be shuffled again
    order = Window.partitionBy("paper_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("paper_id", _text("o", F.col("l_orderkey"))).withColumn("i", F.row_number().over(order))
    # the words of a line are a constant, of which there are four: what a line's own columns say is put in behind
    head = [
        *_laid(10, 5, *"Some prose that stands above the table".split(), right=False, down=False),
        *_laid(10, 100, "Order", right=False), *_laid(165, 100, *"Sizes of the lines and their flags".split(), right=False),
        *[w for k, t in enumerate(("Name", "Quantity", "Flag")) for w in _laid(10 + 150 * k, 120, t)],
    ]
    line = [*_laid(10, 120, "line", ":i", by_line=True), *_laid(160, 120, ":quantity", by_line=True)]
    flag = [*_laid(310, 120, ":flag", by_line=True), *_laid(314, 120, ":after_flag", by_line=True)]
    flagged, first = F.coalesce(F.col("l_returnflag") != "N", F.lit(False)), F.col("i") == 1
    laid = F.when(flagged & first, F.array(*line, *flag, *head)).when(flagged, F.array(*line, *flag)).when(first, F.array(*line, *head)).otherwise(F.array(*line))
    own = [F.col("i").cast("string").alias("i"), (F.col("i") * 20).alias("lower"), F.col("l_quantity").cast("int").cast("string").alias("quantity"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 5).alias("to_right"), (F.col("l_suppkey") % 3).alias("to_down")]
    words = rows.select("paper_id", *own, F.inline(laid))
    word = F.when(F.col("of").isNull(), F.col("given")).when(F.col("of") == "i", F.col("i")).when(F.col("of") == "quantity", F.col("quantity")).when(F.col("of") == "flag", F.col("flag")).otherwise("flag")
    x0 = F.col("dx") + F.when(F.col("right"), F.col("to_right")).otherwise(0) + F.when(F.col("of") == "after_flag", F.length("flag") * 6).otherwise(0)
    y0 = F.col("dy") + F.when(F.col("down"), F.col("to_down")).otherwise(0) + F.when(F.col("by_line"), F.col("lower")).otherwise(0)
    words = words.select("paper_id", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), word.alias("word"))
    words = words.select("paper_id", F.lit(1).alias("page_no"), "x0", "y0", (F.col("x0") + F.length("word") * 6).alias("x1"), (F.col("y0") + 10).alias("y1"), "word")
    return layout.table_cells(words).select("paper_id", "page_no", "table_no", "row_no", "col_no", "cell", "span")


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as two lists of lines: in the second one some went, some came, some read otherwise. What changed, with both numbers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("p"))
    every = orders.select("k", "o", _text("order ", F.col("o"), " of ", F.col("p")).alias("line"), F.lit(0).alias("s"))
    new = every.filter("o % 11 <> 0").withColumn("line", F.when(F.col("o") % 7 == 0, F.concat("line", F.lit(" (paid)"))).otherwise(F.col("line")))
    new = new.unionByName(orders.filter("o % 5 = 0").select("k", "o", _text("note on ", F.col("o")).alias("line"), F.lit(1).alias("s")))
    number = F.row_number().over(Window.partitionBy("k").orderBy("o", "s"))
    found = lines.changes(every.withColumn("line_no", number).select("k", "line_no", "line"), new.withColumn("line_no", number).select("k", "line_no", "line"), ["k"])
    return found.filter("kind <> ' '").select("k", "kind", "a", "b", "line")


def commented_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of six languages whose comments, in lines and in blocks, hold other values, and whose texts hold the marks of comments."""
    n, case = F.col("n"), (F.col("k") % 6 + 1).cast("int")
    texts = [
        _text("/* lr = 0.5;\n batch_size = 3; */ momentum = 0.", F.lpad(n, 2, "0"), ";\nurl = 'http://a#b'; // epochs = 9\nepochs = ", n, ";"),
        _text("%{\nmomentum = 0.5\n%}\nbatch_size = ", n, "; % seed = 3"),
        _text("#= seed = 1\n=# seed = ", n),
        _text("batch_size <- ", n, " # epochs <- 3\nmodel <- 'resnet#", n, "'"),
        _text("<# epochs = 3\n#>\nepochs = ", n),
        _text("batch_size: ", n, " # was 3\nnote: 'a # b'\n"),
    ]
    file = F.concat(F.lit("train."), F.element_at(F.array(*map(F.lit, ("cpp", "m", "jl", "r", "ps1", "yaml"))), case))
    files = _parts(spark, sf_dir).select(F.col("paper_id").alias("code_id"), file.alias("path"), F.lit("lang").alias("kind"), F.element_at(F.array(*texts), case).alias("text"))
    return multilang_evidence(files).select("owner_id", "file", "key", "raw_value", "line")


QUERIES = {f.__name__: f for f in (boxed_tables, changed_lines, commented_code)}

ORACLES = {
    "boxed_tables": """
WITH l AS (SELECT 'o' || l_orderkey AS id, cast(cast(l_quantity AS int) AS varchar) AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
h AS (SELECT DISTINCT id FROM l),
c AS (SELECT id, 0 AS r, unnest([0, 1]) AS k, unnest(['Order', 'Sizes of the lines and their flags']) AS cell, unnest([1, 2]) AS span FROM h
UNION ALL SELECT id, 1, unnest([0, 1, 2]), unnest(['Name', 'Quantity', 'Flag']), 1 FROM h
UNION ALL SELECT id, i + 1, 0, 'line ' || i, 1 FROM l UNION ALL SELECT id, i + 1, 1, q, 1 FROM l UNION ALL SELECT id, i + 1, 2, f || ' flag', 1 FROM l WHERE f <> 'N')
SELECT id AS paper_id, 1 AS page_no, 0 AS table_no, cast(r AS int) AS row_no, k AS col_no, cell, span FROM c""",
    "commented_code": """
WITH p AS (SELECT 'p' || p_partkey AS id, p_partkey % 6 AS m, cast(p_size AS varchar) AS n, '0.' || lpad(cast(p_size AS varchar), 2, '0') AS nn FROM part)
SELECT id AS owner_id, 'train.cpp' AS file, unnest(['momentum', 'epochs']) AS key, unnest([nn, n]) AS raw_value, unnest([2, 4]) AS line FROM p WHERE m = 0
UNION ALL SELECT id, 'train.m', 'batch_size', n, 4 FROM p WHERE m = 1 UNION ALL SELECT id, 'train.jl', 'seed', n, 2 FROM p WHERE m = 2 UNION ALL SELECT id, 'train.r', 'batch_size', n, 1 FROM p WHERE m = 3
UNION ALL SELECT id, 'train.ps1', 'epochs', n, 3 FROM p WHERE m = 4 UNION ALL SELECT id, 'train.yaml', 'batch_size', n, 1 FROM p WHERE m = 5""",
    "changed_lines": """
WITH e AS (SELECT o_custkey AS k, o_orderkey AS o, 'order ' || o_orderkey || ' of ' || o_totalprice AS line, 0 AS s FROM orders),
n AS (SELECT k, o, CASE WHEN o % 7 = 0 THEN line || ' (paid)' ELSE line END AS line, s FROM e WHERE o % 11 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 'note on ' || o_orderkey, 1 FROM orders WHERE o_orderkey % 5 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, s) AS i FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, s) AS i FROM n)
SELECT k, '-' AS kind, i AS a, NULL::BIGINT AS b, line FROM a WHERE o % 11 = 0 OR o % 7 = 0 UNION ALL SELECT k, '+', NULL, i, line FROM b WHERE s = 1 OR o % 7 = 0""",
}
