"""The relational kernels of an audit, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as V
from ..operators import generic as G
from .align import table


def result_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed order totals against the sums of their lines: inner join and tolerance bands."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * 100).cast("decimal(18,0)").alias("c")).groupBy("l_orderkey").agg(F.sum("c").alias("c"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    measured = F.col("c").cast("double") / 100
    return joined.select("o_orderkey", G.tolerance_band(F.col("o_totalprice"), measured).alias("risk"))


def first_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line of the largest quantity of each part."""
    keep = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"]
    return G.best_per_key(table(spark, sf_dir, "lineitem"), ["l_partkey"], [-F.col("l_quantity")], keep)


def rank_gap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return G.rank_gap(lines, "l_orderkey", F.col("l_quantity"), [])


def internal_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose lines carry several discounts; suppliers stand for the files."""
    return G.internal_conflict(table(spark, sf_dir, "lineitem"), "l_partkey", "l_discount", "l_suppkey")


def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distinct_first(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", V.is_thin(F.col("text")).alias("thin"))
    return docs.groupBy("source").agg(F.count_if("thin").alias("n_thin"), F.count_if(~F.col("thin")).alias("n_ok"))


def fingerprint_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.fingerprint(F.col("text").cast("binary")).alias("fp"), V.cache_key("explain", F.col("text")).alias("cache_key"))


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number tokens of the documents in order, each as a number."""
    tokens = F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens).alias("pos", "token")).select("doc_id", "pos", "token", V.normalize_number(F.col("token")).alias("num"))


def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in event properties and prices in several notations."""
    k = F.get_json_object("props", "$.k")
    forms = {"plain": k, "percent": F.concat(k, F.lit("%")), "power": F.concat(k, F.lit("×10^-2")), "kilo": F.concat(k, F.lit("K"))}
    return table(spark, sf_dir, "events").select("event_id", *[V.normalize_number(c).alias(n) for n, c in forms.items()])


def plausible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the verdict of a range table: null where no rule holds."""
    ranges = {"STANDARD": (1, 30, True), "SMALL": (1, 20, True), "LARGE": (20, 50, True)}
    kind = F.split("p_type", " ")[0]
    return table(spark, sf_dir, "part").select("p_partkey", V.within_range(kind, F.col("p_size").cast("double"), ranges).alias("plausible"))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected evidence of both sides with the first reason that holds."""
    events = table(spark, sf_dir, "events").select(F.lit("paper").alias("side"), F.col("event_id").alias("id"), F.col("value").alias("v"))
    parts = table(spark, sf_dir, "part").select(F.lit("code").alias("side"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    reason = V.first_reason([("negative", F.col("v") < 0), ("out of range", F.col("v") > 1500), ("too small", F.col("v") < 5)])
    return events.unionByName(parts).select("side", "id", reason.alias("reason")).filter("reason is not null")


def mention_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of benchmark items that no document holds as a word: mentions without values."""
    said = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''").distinct()
    found = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).distinct()
    return said.join(found, "word", "left_anti")


def grounding_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose collapsed text is in some document. An equi join on the hash of the item's first
    words finds the places; only these are compared, so that no nested loop runs over the corpus."""
    width = 6
    norm = lambda c: V.collapse_space(F.col(c))
    items = table(spark, sf_dir, "benchmark").select("item_id", norm("text").alias("item")).filter("item is not null").withColumn("w", F.split("item", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", norm("text").alias("doc")).withColumn("w", F.split("doc", " "))

    def windows(size: int, of) -> Column:
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: of(F.concat_ws(" ", F.slice("w", i, size))))))

    def inside(some: DataFrame, size: int) -> DataFrame:
        """Items and documents that share ``size`` words after the item's first: its end words may be parts of words."""
        heads = some.select("item_id", F.xxhash64(F.concat_ws(" ", F.slice("w", 2, size))).alias("h"))
        places = docs.filter(F.size("w") >= size).select("doc_id", windows(size, F.xxhash64).alias("h"))
        return heads.join(places, "h").select("item_id", "doc_id").distinct()

    pairs = inside(items.filter(F.size("w") > width + 1), width)
    short = items.filter(F.size("w") <= width + 1).select(F.size("w").alias("n"), F.length("item").alias("length")).distinct().collect()  # few shapes
    for n in sorted({r["n"] for r in short if r["n"] > 2}):
        pairs = pairs.unionByName(inside(items.filter(F.size("w") == n), n - 2))
    found = pairs.distinct().join(items.select("item_id", "item"), "item_id").join(docs.select("doc_id", "doc"), "doc_id").filter(F.contains("doc", "item")).select("item_id")
    for n in sorted({r["n"] for r in short if r["n"] <= 2}):  # no word between its ends: the parts, of its length, of the distinct windows
        texts = docs.filter(F.size("w") >= n).select(windows(n, lambda x: x).alias("t")).distinct()
        for length in sorted({r["length"] for r in short if r["n"] == n}):
            parts = texts.filter(F.length("t") >= length).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - length + 1), lambda i: F.col("t").substr(i, F.lit(length)))).alias("item")).distinct()
            found = found.unionByName(items.filter(F.size("w") == n).join(parts, "item").select("item_id"))
    return found.distinct()


def two_run_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings (document, quality) that two runs agree on."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter("toxic = 0").select("doc_id", "quality").intersect(labels.filter("quality = 1").select("doc_id", "quality"))


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked items of page menus as cells in order, with the neighbour to the right or, for the last, the first."""
    cells = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li><a href=\"[^\"]*\">([^<]*)</a>"), F.lit(1))).alias("col_no", "cell"))
    w = Window.partitionBy("page_id").orderBy("col_no")
    first = F.first("cell").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cells.select("page_id", "col_no", "cell", F.coalesce(F.lead("cell").over(w), first).alias("neighbour"))


def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a digit and their context of one line before and two after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = G.line_context(G.line_table(docs, ["doc_id"], "text"), ["doc_id"]).filter(F.col("line").rlike("[0-9]"))
    return found.select("doc_id", "line_no", F.sha1(F.col("context").cast("binary")).alias("context_sha1"))


def conversation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    carried = G.carry_forward(talks, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section_turn")
    return carried.select("conv_id", "turn", "section_turn")


def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max(V.normalize_number(F.col("value"))).alias("largest"))


def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 less the penalties of each customer's orders by priority, and its mean with a null part left out."""
    status = F.col("o_orderstatus")
    risk = F.when(status == "F", 15).when(status == "O", 8).when(status == "P", 3).otherwise(0)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", risk.alias("pts"))
    part = orders.groupBy("o_custkey", "o_orderpriority").agg(F.greatest(F.lit(0), F.lit(100) - F.sum("pts")).alias("score"))
    return part.groupBy("o_custkey").agg(F.bround(F.avg("score")).cast("int").alias("total"), F.count("*").alias("n_categories"))


def coverage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per = docs.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(~V.is_thin(F.col("text"))).alias("ok"))
    ratio = F.col("ok") / F.col("pages")
    score = F.greatest(F.lit(10), F.lit(100) - F.when(ratio < 0.6, 25).when(ratio < 0.8, 12).otherwise(0))
    level = F.when(score >= 85, "high").when(score >= 65, "medium").otherwise("low")
    return per.select("source", F.bround(ratio, 3).alias("ratio"), score.alias("confidence"), level.alias("level"))


def memory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three newest events stay in detail, the older ones are folded into counts."""
    ranked = G.fold_oldest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", [F.desc("ts"), F.desc("event_id")], 3)
    return ranked.groupBy("user_id").agg(F.count_if(~F.col("folded")).alias("detail"), F.count_if("folded").alias("digest"), F.sum(F.when(~F.col("folded"), F.col("event_id"))).alias("kept_ids"))


def questions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of three kinds with their priority, at most five of a kind: the cap is the feature."""
    orders = table(spark, sf_dir, "orders").select(F.lit("unverified").alias("kind"), F.lit(0).alias("priority"), F.col("o_orderkey").alias("qid"), F.col("o_totalprice").alias("weight"))
    parts = table(spark, sf_dir, "part").select(F.lit("conflict").alias("kind"), F.lit(1).alias("priority"), F.col("p_partkey").alias("qid"), F.col("p_retailprice").alias("weight"))
    customers = table(spark, sf_dir, "customer").select(F.lit("missing").alias("kind"), F.lit(2).alias("priority"), F.col("c_custkey").alias("qid"), F.col("c_acctbal").alias("weight"))
    every = orders.unionByName(parts).unionByName(customers)
    return G.top_k(every, ["kind"], [F.desc("weight"), F.asc("qid")], 5).select("kind", "priority", "qid", "rank")


def repro_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part: its distinct return flags joined in order, and its worst."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("labels"), F.min("l_returnflag").alias("worst"), F.count("*").alias("n"))
    return lines


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of two snapshots of the orders: rows that are gone and rows that are new."""
    orders = table(spark, sf_dir, "orders")
    part = lambda old: orders.filter((F.year("o_orderdate") < 1997) if old else (F.year("o_orderdate") >= 1995)).select("o_custkey", "o_orderstatus")
    return G.both_ways(part(True), part(False)).groupBy("change", "o_orderstatus").agg(F.count("*").alias("n"))


def kinds_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dearest parts of each brand."""
    return G.top_k(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 8).select("p_brand", "p_partkey", "rank")


def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which carriers hold each part: returned lines, open lines, large lines; parts of none are left out."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.bool_or(F.col("l_quantity") >= 45).alias("large"))
    parts = table(spark, sf_dir, "part").select("p_partkey").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.filter("returned or open or large").select("p_partkey", "returned", "open", "large")


_NAMES = [
    result_tolerance, first_best_evidence, rank_gap_verdict, internal_conflict, distinct_first, thin_pages, fingerprint_docs,
    numeric_tokens, normalize_numbers, plausible_filter, rejected_rows, mention_gap, grounding_semi_join, two_run_intersect,
    html_cells, line_context, conversation_sections, json_walk, readiness_score, coverage_confidence, memory_digest,
    questions_union, repro_merge, report_diff, kinds_topk, status_matrix,
]
QUERIES = {f.__name__: f for f in _NAMES}

ORACLES = {
    "result_tolerance": """
WITH l AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS decimal(18,0))) AS c FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_totalprice AS p, cast(c AS double) / 100 AS m FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN abs(p - m) / greatest(abs(p), 1e-12) <= 0.01 THEN 'none'
  WHEN abs(p - m) >= 2.0 OR abs(p - m) / greatest(abs(p), 1e-12) >= 0.05 THEN 'high' ELSE 'medium' END AS risk FROM j""",
    "first_best_evidence": """
SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber, l_suppkey) rn FROM lineitem) WHERE rn = 1""",
    "rank_gap_verdict": """
WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) rn FROM lineitem),
t AS (SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_quantity END) AS top, max(CASE WHEN rn = 2 THEN l_quantity END) AS second, count(*) AS n_sites FROM r GROUP BY 1)
SELECT *, CASE WHEN second IS NULL THEN 'high' WHEN top - second >= 3 THEN 'medium' ELSE 'none' END AS verdict FROM t""",
    "internal_conflict": """
WITH c AS (SELECT l_partkey, count(DISTINCT l_discount) AS n_values, count(DISTINCT l_suppkey) AS n_carriers FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_carriers > 1 THEN 'low' ELSE 'medium' END AS risk FROM c WHERE n_values > 1""",
    "distinct_first": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn, count(*) OVER (PARTITION BY user_id, event_type) n FROM events)
SELECT user_id, event_type, ts, event_id, n FROM r WHERE rn = 1""",
    "thin_pages": "SELECT source, count(*) FILTER (length(trim(text)) < 120) AS n_thin, count(*) FILTER (NOT length(trim(text)) < 120) AS n_ok FROM documents GROUP BY 1",
    "fingerprint_docs": "SELECT doc_id, substr(sha1(text), 1, 10) AS fp, substr(sha256('explain' || chr(0) || text), 1, 24) AS cache_key FROM documents",
    "numeric_tokens": """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1) AS l FROM documents)
SELECT doc_id, cast(i - 1 AS int) AS pos, l[i] AS token, cast(l[i] AS double) AS num FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)""",
    "normalize_numbers": """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
n AS (SELECT event_id, CASE WHEN regexp_full_match(k, '[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?)') THEN cast(k AS double) END AS v, regexp_full_match(k, '[0-9.]+') AS d FROM e)
SELECT event_id, v AS plain, v AS percent, CASE WHEN d THEN v * 0.01 END AS power, CASE WHEN d THEN v * 1000 END AS kilo FROM n""",
    "plausible_filter": """
SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN p_size BETWEEN 1 AND 30 WHEN 'SMALL' THEN p_size BETWEEN 1 AND 20 WHEN 'LARGE' THEN p_size BETWEEN 20 AND 50 END AS plausible FROM part""",
    "rejected_rows": """
WITH u AS (SELECT 'paper' AS side, event_id AS id, value AS v FROM events UNION ALL SELECT 'code', p_partkey, p_retailprice FROM part)
SELECT side, id, CASE WHEN v < 0 THEN 'negative' WHEN v > 1500 THEN 'out of range' ELSE 'too small' END AS reason FROM u WHERE v < 0 OR v > 1500 OR v < 5""",
    "mention_gap": """
SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> ''
EXCEPT SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) FROM documents""",
    "grounding_semi_join": """
WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id FROM b WHERE EXISTS (SELECT 1 FROM d WHERE contains(d.t, b.t))""",
    "two_run_intersect": "SELECT doc_id, quality FROM labels WHERE toxic = 0 INTERSECT SELECT doc_id, quality FROM labels WHERE quality = 1",
    "html_cells": """
WITH t AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)
SELECT page_id, cast(i - 1 AS int) AS col_no, l[i] AS cell, CASE WHEN i < len(l) THEN l[i + 1] ELSE l[1] END AS neighbour FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)""",
    "line_context": """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), i AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM s)
SELECT doc_id, cast(n AS int) AS line_no, sha1(array_to_string(list_slice(l, greatest(n - 1, 1), n + 2), chr(10))) AS context_sha1 FROM i WHERE regexp_matches(l[n], '[0-9]')""",
    "conversation_sections": """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_turn FROM conversations""",
    "json_walk": """
WITH p AS (SELECT unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT key, json_extract_string(props, '$.' || key) AS value FROM p)
SELECT key, count(*) AS n, count(DISTINCT value) AS n_values, max(try_cast(value AS double)) AS largest FROM v GROUP BY 1""",
    "readiness_score": """
WITH p AS (SELECT o_custkey, o_orderpriority, greatest(0, 100 - sum(CASE o_orderstatus WHEN 'F' THEN 15 WHEN 'O' THEN 8 WHEN 'P' THEN 3 ELSE 0 END)) AS score FROM orders GROUP BY 1, 2)
SELECT o_custkey, cast(round_even(avg(score), 0) AS int) AS total, count(*) AS n_categories FROM p GROUP BY 1""",
    "coverage_confidence": """
WITH p AS (SELECT source, count(*) AS pages, count(*) FILTER (NOT length(trim(text)) < 120) AS ok FROM documents GROUP BY 1),
s AS (SELECT source, ok / pages AS r, greatest(10, 100 - CASE WHEN ok / pages < 0.6 THEN 25 WHEN ok / pages < 0.8 THEN 12 ELSE 0 END) AS confidence FROM p)
SELECT source, round_even(r, 3) AS ratio, confidence, CASE WHEN confidence >= 85 THEN 'high' WHEN confidence >= 65 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "memory_digest": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) FILTER (rn <= 3) AS detail, count(*) FILTER (rn > 3) AS digest, cast(sum(CASE WHEN rn <= 3 THEN event_id END) AS bigint) AS kept_ids FROM r GROUP BY 1""",
    "questions_union": """
WITH q AS (SELECT 'unverified' AS kind, 0 AS priority, o_orderkey AS qid, o_totalprice AS weight FROM orders
  UNION ALL SELECT 'conflict', 1, p_partkey, p_retailprice FROM part UNION ALL SELECT 'missing', 2, c_custkey, c_acctbal FROM customer),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY kind ORDER BY weight DESC, qid) AS int) AS rank FROM q)
SELECT kind, priority, qid, rank FROM r WHERE rank <= 5""",
    "repro_merge": "SELECT l_partkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS labels, min(l_returnflag) AS worst, count(*) AS n FROM lineitem GROUP BY 1",
    "report_diff": """
WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) < 1997), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1995),
u AS (SELECT 'gone' AS change, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'new', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT change, o_orderstatus, count(*) AS n FROM u GROUP BY 1, 2""",
    "kinds_topk": "SELECT p_brand, p_partkey, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS int) AS rank FROM part) WHERE rank <= 8",
    "status_matrix": """
SELECT p_partkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open, bool_or(l_quantity >= 45) AS large
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1 HAVING bool_or(l_returnflag = 'R') OR bool_or(l_linestatus = 'O') OR bool_or(l_quantity >= 45)""",
}
