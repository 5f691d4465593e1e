"""Whole audits, and the ladder under budgets, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import fill_within
from ..plans.audit import audit
from .audits import _pages, _parts, _text


def whole_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit for each part from pages and code to its tables: findings of three parameters, values that were refused, files that failed, and coverage."""
    parts, n, k = _parts(spark, sf_dir), F.col("n"), F.col("k")
    pages = _pages(parts, _text("We use a batch size of ", n, " here. All models are trained for ", n + 1, " epochs. The dropout of ", n + 1, " is used. ", F.repeat(F.lit("Plain words follow. "), F.lit(9))), F.when(k % 5 == 0, "").otherwise(F.repeat(F.lit("Plain words without any value. "), 9)))
    size = n + (k % 3 == 0).cast("int")
    text = F.concat(_text("import torch\nbatch_size = ", size, "\n"), F.when(k % 2 == 0, _text("epochs = ", n + 1, "\n")).otherwise(""), F.when(k % 7 == 0, "momentum = 0.9\n").otherwise(""))
    files = parts.select(F.col("paper_id").alias("code_id"), F.explode(F.array(F.struct(F.lit("train.py").alias("path"), text.alias("text")), F.struct(F.lit("bad.py").alias("path"), F.when(k % 11 == 0, "def broken(:").otherwise("x = 1").alias("text")))).alias("f"))
    files = files.select("code_id", "f.path", F.lit("py").alias("kind"), "f.text")
    audits = parts.select(F.concat(F.lit("a-"), "paper_id").alias("audit_id"), "paper_id", F.col("paper_id").alias("code_id"))
    out = audit(spark, audits, pages, files)
    found = out["findings"].filter("key in ('batch_size', 'epochs', 'momentum')")
    told = lambda df, table, key, a, b: df.select("audit_id", F.lit(table).alias("table"), key.alias("key"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    rows = told(found, "finding", F.col("key"), F.col("status"), F.concat_ws("/", F.coalesce("paper.raw_value", F.lit("-")), F.coalesce("code.raw_value", F.lit("-")), F.col("verified").cast("string")))
    rows = rows.unionByName(told(out["rejected"].filter("key = 'dropout'").distinct(), "rejected", F.col("key"), F.col("value"), F.col("location")))
    rows = rows.unionByName(told(out["failed_files"].select("audit_id", "file").distinct(), "failed", F.col("file"), F.lit(None), F.lit(None)))
    return rows.unionByName(told(out["coverage"], "coverage", F.lit("pages"), F.concat_ws("/", "pages_parsed", "pages_total", "pages_thin"), F.concat_ws("/", "code_ok", "code_files")))


def budgeted_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five missing parameters of each part's paper, of which a model may be asked for three and images for two: what became of each at every rung."""
    parts = _parts(spark, sf_dir)
    pages = _pages(parts, _text("Here seed, momentum, epochs, dropout and weight decay matter. Values of run ", F.col("n") + 1, " are in a list."))
    keys = F.explode(F.array(*map(F.lit, ("seed", "momentum", "epochs", "dropout", "weight_decay"))))
    mentioned = parts.select("paper_id", keys.alias("key"))
    sizes = parts.select("paper_id", "n", "k")

    def propose(requests: DataFrame) -> DataFrame:
        value = (F.col("n") + 1).cast("string")
        return requests.join(sizes.hint("merge"), "paper_id").select("paper_id", F.lit(1).alias("page_no"), "key", value.alias("value"), _text("Values of run ", value, " are").alias("evidence"))

    def read(requests: DataFrame) -> DataFrame:
        run = F.explode(F.array(F.lit(1), F.lit(2)))
        low = _text("0.", F.lpad(F.col("n"), 2, "0"))
        value = F.when(F.col("key") == "momentum", "0.9").when((F.col("k") % 2 == 1) & (F.col("run") == 2), "0.77").otherwise(low)
        rows = requests.join(sizes.hint("merge"), "paper_id").select("*", run.alias("run"))
        return rows.select("paper_id", F.lit(1).alias("page_no"), F.lit("table").alias("region_kind"), "run", F.col("key").alias("name"), value.alias("value"), F.lit("seen").alias("evidence_text"))

    out = fill_within(pages, mentioned, spark.createDataFrame([], "owner_id string, key string"), propose, read)
    fills = out["fills"].select("paper_id", "key", "tool", "value")
    told = out["trace"].join(fills.hint("merge"), ["paper_id", "key", "tool"], "left")
    return told.join(out["ledger"].select("paper_id", F.col("kind").alias("tool"), "calls", "left_out").hint("merge"), ["paper_id", "tool"], "left").select("paper_id", "key", "attempt", "tool", "status", "value", "calls", "left_out")


QUERIES = {"whole_audits": whole_audits, "budgeted_fills": budgeted_fills}

ORACLES = {
    "whole_audits": """
WITH p AS (SELECT 'a-p' || p_partkey AS id, p_partkey AS k, p_size AS n FROM part)
SELECT id AS audit_id, 'finding' AS "table", 'batch_size' AS key, CASE WHEN k % 3 = 0 THEN 'inconsistent' ELSE 'consistent' END AS a, n || '/' || (n + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) || '/true' AS b FROM p
UNION ALL SELECT id, 'finding', 'epochs', CASE WHEN k % 2 = 0 THEN 'consistent' ELSE 'missing_in_code' END, (n + 1) || '/' || CASE WHEN k % 2 = 0 THEN cast(n + 1 AS varchar) ELSE '-' END || '/true' FROM p
UNION ALL SELECT id, 'finding', 'momentum', 'missing_in_paper', '-/0.9/true' FROM p WHERE k % 7 = 0
UNION ALL SELECT id, 'rejected', 'dropout', cast(n + 1 AS varchar), 'Page 1' FROM p
UNION ALL SELECT id, 'failed', 'bad.py', NULL, NULL FROM p WHERE k % 11 = 0
UNION ALL SELECT id, 'coverage', 'pages', CASE WHEN k % 5 = 0 THEN '1/2/1' ELSE '2/2/0' END, CASE WHEN k % 11 = 0 THEN '1/2' ELSE '2/2' END FROM p""",
    "budgeted_fills": """
WITH p AS (SELECT 'p' || p_partkey AS id, p_partkey % 2 AS odd, cast(p_size + 1 AS varchar) AS v, '0.' || lpad(cast(p_size AS varchar), 2, '0') AS nn FROM part),
k AS (SELECT id, odd, v, nn, unnest(['dropout', 'epochs', 'momentum', 'seed', 'weight_decay']) AS key FROM p)
SELECT id AS paper_id, key, unnest([1, 2, 3]) AS attempt, unnest(['text-l1', 'text-l2', 'negation']) AS tool, 'no_hit' AS status, NULL AS value, NULL::BIGINT AS calls, NULL::BIGINT AS left_out FROM k
UNION ALL SELECT id, key, 4, 'model', CASE WHEN key = 'epochs' THEN 'accepted' WHEN key < 'n' THEN 'rejected' ELSE 'skipped' END, CASE WHEN key = 'epochs' THEN v END, 3, 2 FROM k
UNION ALL SELECT id, key, 5, 'images', CASE WHEN key > 'n' THEN 'skipped' WHEN key = 'dropout' AND odd = 1 THEN 'no_hit' ELSE 'accepted' END,
  CASE WHEN key = 'momentum' THEN '0.9' WHEN key = 'dropout' AND odd = 0 THEN nn END, 2, 2 FROM k WHERE key <> 'epochs'""",
}
