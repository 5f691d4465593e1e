"""Operators of the audit over audits that are planted in the driver's tables: texts, code and evidence are made from their
columns by expressions, go through the library's operators, and the SQL tells what must come out from the columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import agent, align, explain, inquiry, memory, score, trace, verify
from ..operators import extract_paper as paper
from ..operators.extract_code import code_evidence
from .align import table

def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows by their key over all cores. A small file, or one row group, is read by one task, which would also do all the work on the texts made from it."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper for each part: paper_id, n (its size), k (its key)."""
    parts = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select(_text("p", F.col("p_partkey")).alias("paper_id"), F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))


def _pages(df: DataFrame, *texts: Column) -> DataFrame:
    """Pages of each paper with these texts."""
    page = F.explode(F.array(*[F.struct(F.lit(i).alias("page_no"), t.alias("text")) for i, t in enumerate(texts, 1)]))
    return df.select("paper_id", page.alias("p")).select("paper_id", "p.page_no", "p.text", F.lit(0).alias("n_images"))


def _evidence(df: DataFrame, side: str, audit: Column, key: Column, raw: Column, *, ordinal: Column | int = 0, location: Column | str = "Page 1", file: Column | None = None, line: Column | None = None) -> DataFrame:
    """Evidence with the columns of the engine, of one owner an audit."""
    num, of = V.normalize_number(raw), lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        audit.cast("string").alias("audit_id"), audit.cast("string").alias("owner_id"), F.lit(side).alias("side"), key.alias("key"), of(ordinal).cast("bigint").alias("ordinal"), raw.alias("raw_value"), num.alias("num"),
        F.when(num.isNull(), F.lower(raw)).alias("txt"), of(location).alias("location"), of(file).cast("string").alias("file"), F.lit(1).alias("page"), of(line).cast("int").alias("line"),
        _text("value ", raw).alias("snippet"), F.lit("text").alias("channel"), F.lit(False).alias("excluded"), F.lit("assign").alias("form"),
    )


def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values behind, before and further from a parameter's name, in pages that are made of part sizes."""
    text = _text("We use a batch size of ", F.col("n"), " here.\nAll models are trained for ", F.col("n") + 1, " epochs.\nThe momentum that we have found to be the best was 0.", F.lpad(F.col("n"), 2, "0"), " in the end.")
    found = paper.paper_evidence(_pages(_parts(spark, sf_dir), F.lit("Nothing to see."), text))["evidence"]
    return found.filter(F.col("key").isin("batch_size", "epochs", "momentum")).select("owner_id", "key", "raw_value", "num", "page", "location", "channel", "excluded")


def rejected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a guard refuses, with the first reason: references, other meanings, formulas, columns of numbers, ranges."""
    n, case = F.col("n"), F.col("k") % 6
    text = (
        F.when(case == 0, _text("We take a batch size of ", n, " as in arXiv:2001.01234 before."))
        .when(case == 1, _text("The learning rate drops every ", n, " epochs, so we train for ", n, " epochs."))
        .when(case == 2, _text("The dropout of 0.", F.lpad(n, 2, "0"), " × 3 is used."))
        .when(case == 3, _text("Here the dropout ", n, " 11 12 is listed."))
        .when(case == 4, _text("The dropout of ", n, " is used."))
        .otherwise(_text("We use a batch size of ", n, " here."))
    )
    found = paper.paper_evidence(_pages(_parts(spark, sf_dir), text))["rejected"]
    return found.filter(F.col("key").isin("batch_size", "epochs", "dropout")).select("owner_id", "key", "value", "location", "reason").distinct()


def text_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizers, models and data sets: the first accepted name, references and prose words aside."""
    optimizer, data = F.element_at(F.array(*map(F.lit, ["Adam", "SGD", "RMSprop"])), (F.col("n") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ["MNIST", "SVHN"])), (F.col("n") % 2 + 1).cast("int"))
    first = F.when(F.col("k") % 4 == 0, "[3] A study of RMSprop optimizer").otherwise("A study")
    second = _text("We use the ", optimizer, " optimizer here.\nOur network is a ResNet-", F.col("n"), " and it is small.\nWe train on ", data, " only.")
    found = paper.paper_evidence(_pages(_parts(spark, sf_dir), first, second))["evidence"]
    return found.filter(F.col("key").isin("optimizer", "model", "dataset")).select("owner_id", "key", "raw_value", "txt", "page")


def claimed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that papers claim against measured ones."""
    text = _text("Our method has an accuracy of ", F.col("n"), ".5 in the end. The loss of 0.", F.col("n"), " is small.")
    parts = _parts(spark, sf_dir)
    claims = paper.paper_evidence(_pages(parts, text))["results"].withColumn("audit_id", F.col("owner_id"))
    measured = parts.filter("k % 3 <> 0").select(F.col("paper_id").alias("audit_id"), F.lit("accuracy").alias("metric"), (F.col("n") + 0.5 + (F.col("k") % 5)).cast("double").alias("value"))
    return align.align_results(claims, measured).select("audit_id", "key", "category", "status", "risk", "confidence", F.col("paper.num").alias("claimed"), F.col("code.num").alias("measured"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of parameter tables; a table of a sweep is set apart."""
    n = F.col("n").cast("string")
    head = F.when(F.col("k") % 5 == 0, "Ablation setting").otherwise("Setting")
    rows = [(0, 0, head), (0, 1, F.lit("Value")), (1, 0, F.lit("batch size")), (1, 1, n), (2, 0, F.lit("")), (2, 1, F.lit("Dropout")), (2, 2, _text("0.", F.lpad(n, 2, "0"))), (3, 0, F.lit("7")), (3, 1, F.lit("momentum")), (4, 0, F.lit("Optimizer")), (4, 1, F.lit("Adam W"))]
    cell = F.explode(F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), v.alias("cell")) for r, c, v in rows]))
    cells = _parts(spark, sf_dir).select("paper_id", F.lit(2).alias("page_no"), F.lit(1).alias("table_no"), cell.alias("x")).select("paper_id", "page_no", "table_no", "x.*")
    return paper.table_claims(cells).select("owner_id", "key", "raw_value", "num", "txt", "location", "page", "line", "channel", "excluded")


def mentioned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that a page names, those without a value, the declarations of a page, and its title."""
    n = F.col("n")
    text = F.when(n % 4 == 0, "About momentum\nThe weight decay and the momentum are tuned.").when(n % 4 == 1, _text("On seeds\nThe random seed is ", n, " here, and batch_size = ", n, ".")).when(n % 4 == 2, "12\nThe design iterations took long.").otherwise("Training iterations are many.")
    pages = _pages(_parts(spark, sf_dir), text)
    named = paper.mentioned_kinds(pages)
    open_ = agent.missing(named, paper.paper_evidence(pages)["evidence"]).withColumn("open", F.lit(True))
    rows = named.join(open_, ["paper_id", "key"], "left").join(paper.declarations(pages), "paper_id").join(paper.title_and_abstract(pages).select("paper_id", "title"), "paper_id")
    return rows.select("paper_id", "key", F.coalesce("open", F.lit(False)).alias("open"), F.col("n").alias("declared"), "title")


def cjk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and mentions by Chinese names, with and without a connector, a symbol or another name between, beside English ones."""
    n, low = F.col("n"), F.lpad(F.col("n"), 2, "0")
    text = (
        F.when(F.col("k") % 4 == 0, _text("本文的批大小为 ", n, "。学习率 r=0.", low, "。动量未作说明。"))
        .when(F.col("k") % 4 == 1, _text("训练轮数设置为", n, "，权重衰减取 0.", low, "。随机种子尚未给出。"))
        .when(F.col("k") % 4 == 2, _text("聚类簇数为", n, "。杀伤半径 ", n, " 米。阈值未定。"))
        .otherwise(_text("批量大小 ", n, "; the momentum is 0.", low, "。"))
    )
    pages = _pages(_parts(spark, sf_dir), text)
    found = paper.paper_evidence(pages)["evidence"].select(F.col("owner_id").alias("paper_id"), "key", "raw_value")
    return paper.mentioned_kinds(pages).join(found, ["paper_id", "key"], "left")


def code_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments, call arguments and defaults in Python files; a file that does not parse gives nothing."""
    n = F.col("n")
    body = _text("import torch\nbatch_size = ", n, "\nopt = torch.optim.SGD(params, lr=0.", F.lpad(n, 2, "0"), ", momentum=0.9)\n")
    text = F.when(F.col("k") % 7 == 0, _text(body, "def broken(:\n")).otherwise(body)
    files = _parts(spark, sf_dir).select(F.col("paper_id").alias("code_id"), F.lit("train.py").alias("path"), F.lit("py").alias("kind"), text.alias("text"))
    found, _ = code_evidence(files)
    return found.filter("reason is null and key in ('batch_size', 'learning_rate', 'momentum', 'optimizer')").select("owner_id", "key", "raw_value", "num", "txt", "file", "line").distinct()


def failed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse, with their number of lines."""
    text = F.when(F.col("k") % 7 == 0, F.concat(F.repeat(F.lit("x = 1\n"), F.col("n")), F.lit("def broken(:"))).otherwise("x = 1")
    files = _parts(spark, sf_dir).select(F.col("paper_id").alias("code_id"), F.lit("a/train.py").alias("path"), F.lit("py").alias("kind"), text.alias("text"))
    return code_evidence(files)[1].select("code_id", "file", "lines")


def _order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as papers that claim a batch size, their lines as code: returned ones in the training folder, new ones in tests."""
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    claims = _evidence(orders, "paper", F.col("o_orderkey"), F.lit("batch_size"), (F.col("o_orderkey") % 50 + 1).cast("string"))
    place = F.when(F.col("l_returnflag") == "R", "train/f").when(F.col("l_returnflag") == "A", "lib/f").otherwise("tests/f")
    file = _text(place, F.col("l_linenumber"), ".py")
    code = _evidence(table(spark, sf_dir, "lineitem"), "code", F.col("l_orderkey"), F.lit("batch_size"), F.col("l_quantity").cast("int").cast("string"), ordinal=F.col("l_linenumber"), location=_text(file, ":", F.col("l_linenumber")), file=file, line=F.col("l_linenumber"))
    return claims, code


def aligned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best evidence of each side, full outer join, status and risk."""
    found = align.align_params(*_order_sides(spark, sf_dir))
    return found.select("audit_id", "key", "display", "category", "status", "risk", "risk_ord", F.col("paper.raw_value").alias("claimed"), F.col("code.raw_value").alias("coded"), F.col("code.location").alias("place"))


def conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits whose code holds several values of a parameter outside tests."""
    claims, code = _order_sides(spark, sf_dir)
    found = align.conflicts(claims, code)
    return found.select("audit_id", "key", "status", "risk", F.col("code.raw_value").alias("first"), F.size("extra").alias("more"))


def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image readings that two runs agree on, for parameters that no text gave, against the code."""
    parts = _parts(spark, sf_dir)
    run = lambda i, value: parts.select(F.col("paper_id").alias("audit_id"), "paper_id", F.lit(3).alias("page_no"), F.lit("table").alias("region_kind"), F.lit(i).alias("run"), F.lit("Batch-Size").alias("name"), value.cast("string").alias("value"), F.lit("seen").alias("evidence_text"))
    readings = run(1, F.col("n")).unionByName(run(2, F.col("n") + (F.col("k") % 3 == 0).cast("int")))
    claims = _evidence(parts.filter("k % 5 = 0"), "paper", F.col("paper_id"), F.lit("batch_size"), F.lit("8"))
    code = _evidence(parts.filter("k % 2 = 0"), "code", F.col("paper_id"), F.lit("batch_size"), (F.col("n") + F.col("k") % 4).cast("string"), location="train.py:1", file=F.lit("train.py"), line=F.lit(1))
    return align.align_images(readings, claims, code).select("audit_id", "key", "status", "risk", "confidence", F.col("paper.raw_value").alias("seen"), F.col("paper.location").alias("place"), F.col("code.raw_value").alias("coded"))


def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed values with the first check that refuses them, one kind of proposal for each remainder of the part's key."""
    n, case = F.col("n").cast("string"), F.col("k") % 12
    cases = [  # key, value, evidence, whether a page holds the evidence
        ("batch_size", n, _text("the batch size was ", n, " then"), True),
        ("batch_size", n, _text("the batch size was ", n, " then"), False),
        ("batch_size", n, _text("batch size 7 8 ", n, " 9 10"), True),
        ("batch_size", n, _text("batch size as in [", n, "] before"), True),
        ("dropout", F.lit("0.8"), _text("a keep ratio of 0.8 in run ", n), True),
        ("optimizer", n, _text("the optimizer of table ", n), True),
        ("sigma_xy", n, _text("sigma drawn from normal(0, ", n, ") here"), True),
        ("batch_size", _text("4-", n), _text("batch size of 4-", n, " was tried"), True),
        ("batch_size", _text(n, " or so"), _text("batch size of ", n, " or so"), True),
        ("batch_size", F.lit("640"), _text("batch size of ", n, " then"), True),
        ("dropout", _text(n, ".5"), _text("a dropout of ", n, ".5 then"), True),
        ("input_size", F.lit("64"), _text("inputs of 64 pixels in run ", n), True),
    ]
    pick = lambda i: F.element_at(F.array(*[c[i] if isinstance(c[i], Column) else F.lit(c[i]) for c in cases]), (case + 1).cast("int"))
    parts = _parts(spark, sf_dir)
    candidates = parts.select("paper_id", pick(0).alias("key"), pick(1).alias("value"), pick(2).alias("evidence"))
    pages = _pages(parts, F.lit("first page"), F.when(pick(3), _text("Before.  It says:\n", pick(2), " and so on.")).otherwise("Another text."))
    return agent.gate(candidates, pages).select("paper_id", "key", "ok", "why")


def ladder_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near the names of parameters that have none: tight ones, then further ones, then proposals."""
    n, case = F.col("n").cast("string"), F.col("k") % 4
    text = (
        F.when(case == 0, _text("For this run a total of ", n, " epochs were seen."))
        .when(case == 1, _text("As for the epochs of this training it was ", n, " or less."))
        .when(case == 2, _text("There is no early stop and no epochs ", n, " in this run."))
        .otherwise("Many epochs were needed for this.")
    )
    parts = _parts(spark, sf_dir)
    pages = _pages(parts, text)
    named = parts.select("paper_id", F.lit("epochs").alias("key"))
    nothing = _evidence(parts.limit(0), "paper", F.col("paper_id"), F.lit("epochs"), F.lit("1"))
    offered = parts.filter("k % 8 = 3").select("paper_id", F.lit(1).alias("page_no"), F.lit("epochs").alias("key"), F.lit("many").alias("value"), F.lit("Many epochs were needed").alias("evidence"))
    got = agent.fill_missing(pages, named, nothing, offered)
    hinted = got["hints"].select("paper_id", F.lit(True).alias("hint"))
    rows = got["fills"].select("paper_id", "value", "rung").join(hinted, "paper_id", "full_outer").join(got["unfilled"].select("paper_id", F.lit(True).alias("unfilled")), "paper_id", "full_outer")
    return rows.select("paper_id", "value", "rung", F.coalesce("hint", F.lit(False)).alias("hint"), F.coalesce("unfilled", F.lit(False)).alias("unfilled"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every order over its own batch size and that of its lines, in the order of a report."""
    claims, code = _order_sides(spark, sf_dir)
    lengths = code.select("audit_id", "file", F.lit(6).alias("n_lines")).distinct()
    return align.ordered(verify.selfcheck(align.compare(claims, code), lengths))


def checked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their place in the report and whether they replay; lines beyond a file's end do not."""
    found = _findings(spark, sf_dir)
    return found.select("audit_id", "status", "seq", "verified", (F.col("verify_note") == "代码行号超出文件范围").alias("beyond"))


def snippets_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a snippet shows a value: as it is, without separators, in another notation, or not."""
    n, case = F.col("n"), F.col("k") % 5
    snippet = F.when(case == 0, _text("is ", n, " here")).when(case == 1, _text("is ", n, ",000 here")).when(case == 2, _text("is ", n, "e3 here")).when(case == 3, _text("Layer-", n, "_x here")).otherwise("nothing")
    raw = F.when(case == 0, n.cast("string")).when(case == 3, _text("layer ", n, "-X")).otherwise(_text(n, "000"))
    return _parts(spark, sf_dir).select("paper_id", verify.snippet_contains(snippet, raw).alias("shown"))


def audit_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer's audit: their orders are findings, by priority; what was not checked is null."""
    orders = table(spark, sf_dir, "orders")
    risk = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    side = F.struct(F.when(F.col("o_orderpriority").startswith("1"), "vision").otherwise("text").alias("channel"))
    findings = orders.select(F.col("o_custkey").cast("string").alias("audit_id"), F.when(F.col("o_orderkey") % 3 == 0, "data").otherwise("param").alias("category"), risk.alias("risk"), side.alias("paper"), F.struct(F.lit("text").alias("channel")).alias("code"))
    customers = table(spark, sf_dir, "customer")
    audits = customers.select(F.col("c_custkey").cast("string").alias("audit_id"), F.when(F.col("c_custkey") % 5 != 0, _text("c", F.col("c_custkey"))).alias("code_id"))
    files = customers.filter("c_custkey % 5 <> 0").select(_text("c", F.col("c_custkey")).alias("code_id"))
    needs = customers.filter("c_custkey % 10 = 1").select(_text("c", F.col("c_custkey")).alias("code_id"))
    measured = customers.filter("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("audit_id"))
    return score.readiness(audits, findings, needs, files, measured).select("audit_id", "category", "score", (F.col("unverified_reason") != "").alias("unverified"))


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source's documents can be read, and the confidence that follows."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_no"), "text")
    sources = docs.select("source").distinct()
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    audits = sources.select(F.col("source").alias("audit_id"), F.col("source").alias("paper_id"), F.col("source").alias("code_id"))
    kinds = sources.select(F.col("source").alias("paper_id"), F.explode(F.array(*map(F.lit, ["epochs", "seed", "dropout", "momentum"]))).alias("key"), number.alias("x"))
    valued = kinds.filter("(x % 2 = 0 and key in ('epochs', 'seed')) or key = 'dropout'").select(F.col("paper_id").alias("owner_id"), "key")
    files = sources.select(F.col("source").alias("code_id"), F.explode(F.sequence(F.lit(1), F.lit(6)).cast("array<string>")).alias("file"), number.alias("x"))
    failed = files.filter("cast(file as int) <= x % 5").select("code_id", "file")
    checked = sources.select(F.col("source").alias("audit_id"), (number % 6 != 0).alias("verified"))
    read = pages.filter("page_no % 2 = 0").select("paper_id", "page_no")
    found = verify.coverage(audits, pages, kinds.select("paper_id", "key"), valued, files, failed, checked, read)
    level = {"高": "high", "中": "medium", "低": "low"}
    return found.select("audit_id", "pages_total", "pages_thin", "pages_covered", "kinds_seen", "kinds_valued", "code_ok", "page_ratio", "kind_ratio", "confidence_score", F.replace(F.replace(F.replace("level", *map(F.lit, ("高", level["高"]))), *map(F.lit, ("中", level["中"]))), *map(F.lit, ("低", level["低"]))).alias("level"))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parameter against every carrier, and the channels that gave it."""
    parts = _parts(spark, sf_dir)
    some = lambda where, key: parts.filter(where).select(F.col("paper_id").alias("audit_id"), F.lit(key).alias("key"))
    rows = verify.param_matrix(spark, some("k % 2 = 0", "epochs"), some("k % 3 = 0", "epochs"), some("k % 2 = 1", "seed").unionByName(some("k % 4 = 0", "epochs")), some("k % 5 = 0", "seed"))
    seen = parts.select(F.col("paper_id").alias("owner_id"), F.lit("epochs").alias("key"), F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit("text"), F.lit("table"), F.lit("text"))).otherwise(F.array(F.lit("vision")))).alias("channel"))
    joined = rows.join(verify.channels(seen).withColumnRenamed("owner_id", "audit_id"), ["audit_id", "key"], "left")
    return joined.select("audit_id", "key", "display", "in_paper", "in_image", "in_code", "mentioned", F.array_join("channels", "+").alias("channels"))


def effective_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment that takes effect of every inconsistent parameter, and how sure that is."""
    found = trace.traces(_findings(spark, sf_dir), _order_sides(spark, sf_dir)[1])
    return found.select("audit_id", "key", "verdict", "verdict_loc", "confidence", F.size("candidates").alias("n"))


def patch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value patches, drafted or refused by the first of the gates, one kind of case for each remainder of the part's key."""
    n, case = F.col("n").cast("string"), F.col("k") % 13
    cases = [  # key, status, confidence of the trace, claimed value, snippet, line of code, value in it, claims of other values
        ("batch_size", "inconsistent", "high", n, F.lit("batch size"), _text("batch_size = 640  # not ", n), "640", 0),
        ("batch_size", "internal_inconsistent", "high", n, F.lit("s"), F.lit("batch_size = 640"), "640", 0),
        ("model", "inconsistent", "high", n, F.lit("s"), F.lit("model = 640"), "640", 0),
        ("batch_size", "inconsistent", "high", n, F.lit("s"), F.lit("batch_size = 640"), "640", 1),
        ("batch_size", "inconsistent", "none", n, F.lit("s"), F.lit("batch_size = 640"), "640", 0),
        ("batch_size", "inconsistent", "high", F.lit(""), F.lit("s"), F.lit("batch_size = 640"), "640", 0),
        ("batch_size", "inconsistent", "high", _text(n, ","), F.lit("s"), F.lit("batch_size = 640"), "640", 0),
        ("batch_size", "inconsistent", "high", F.lit("large"), F.lit("s"), F.lit("batch_size = 640"), "640", 0),
        ("batch_size", "inconsistent", "high", n, F.lit("s"), F.lit(None).cast("string"), "640", 0),
        ("warmup", "inconsistent", "high", n, F.lit("warm up for some steps"), F.lit("WARMUP_EPOCHS = 640"), "640", 0),
        ("learning_rate", "inconsistent", "high", _text("0.", n), F.lit("s"), F.lit("add('--lr', type=int, default=640)"), "640", 0),
        ("batch_size", "inconsistent", "high", n, F.lit("s"), F.lit("batch_size = other"), "640", 0),
        ("batch_size", "inconsistent", "high", n, F.lit("s"), F.lit("pair = (640, 640)"), "640", 0),
    ]
    pick = lambda i: F.element_at(F.array(*[c[i] if isinstance(c[i], Column) else F.lit(c[i]) for c in cases]), (case + 1).cast("int"))
    planted = _parts(spark, sf_dir).select(F.col("paper_id").alias("audit_id"), *[pick(i).alias(c) for i, c in enumerate(("key", "status", "confidence", "raw", "snippet", "before", "verdict", "more"))])
    num = V.normalize_number(F.col("raw"))
    findings = planted.select("audit_id", "key", F.lit(1).alias("seq"), "status", F.struct(F.col("raw").alias("raw_value"), num.alias("num"), F.lower("raw").alias("txt"), "snippet").alias("paper"))
    found = planted.select("audit_id", "key", F.lit(1).alias("seq"), "verdict", F.lit("train.py:3").alias("verdict_loc"), F.lit("train.py").alias("file"), F.lit(3).alias("line"), "confidence")
    lines = planted.filter("before is not null").select("audit_id", F.lit("train.py").alias("file"), F.lit(3).alias("line"), F.col("before").alias("text"))
    claims = _evidence(planted.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("more")))), "paper", F.col("audit_id"), F.col("key"), (F.lit(7) + F.col("i")).cast("string"))
    return trace.patches(findings, found, lines, claims).select("audit_id", "key", "status", "refuse_kind", "after")


def _line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten orders each as findings of one audit: status and risk by flags and quantity, the values on both sides, and some read from images."""
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey") % 7
    status = F.element_at(F.array(*map(F.lit, ["inconsistent", "inconsistent", "inconsistent", "unverifiable", "internal_inconsistent", "missing_in_paper", "missing_in_code"])), (n + 1).cast("int"))
    channel = F.when(F.col("l_suppkey") % 9 == 0, "vision").otherwise("text")
    side = lambda prefix: F.struct(_text(prefix, F.col("l_linenumber")).alias("raw_value"), _text(prefix, " place").alias("location"), channel.alias("channel"))
    return lines.select(
        F.floor(F.col("l_orderkey") / 10).cast("string").alias("audit_id"), _line_key().alias("key"), _line_key().alias("display"), F.col("l_partkey").alias("seq"), status.alias("status"),
        F.when(F.col("l_quantity") < 40, "high").otherwise("medium").alias("risk"), side("p").alias("paper"), side("c").alias("code"), F.lit("n").alias("note"), (F.col("l_suppkey") % 10 > 0).alias("verified"), F.lit("v").alias("verify_note"),
    )


def _line_key() -> Column:
    return _text("k", F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-", F.col("l_suppkey"))


def asked_and_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to a person with their answers: all conflicts of high and medium risk, files, missing values and images; blank answers are none."""
    found = _line_findings(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").withColumn("audit_id", F.floor(F.col("o_orderkey") / 10).cast("string"))
    key = lambda where: orders.filter(where).select("audit_id", _text("x", F.col("o_orderkey")).alias("key"))
    failed = orders.select("audit_id", _text("f", F.col("o_orderkey"), ".py").alias("file"), F.lit("r").alias("reason"))
    asked = inquiry.build_questions(found, key("o_orderstatus = 'O'"), key("o_orderstatus = 'F'"), failed, None, None, ("high", "medium"))
    answers = asked.select("audit_id", "qid", F.when(F.col("priority") == 1, "  ").otherwise(_text(" yes ", F.col("qid"))).alias("answer"))
    return asked.join(inquiry.apply_answers(asked, answers).select("audit_id", "qid", "answer"), ["audit_id", "qid"], "left").join(inquiry.summarize(asked), ["audit_id", "kind"]).select("audit_id", "kind", "priority", "qid", "answer", "n")


def repeat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each parameter with both values, statuses and the gravest risk, ranked."""
    rows = inquiry.repro_rows(_findings(spark, sf_dir))
    return inquiry.with_ranks(rows).select("audit_id", "key", "paper_value", "code_value", "status", "risk", "rank")


def manual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person should look at, by urgency: one item for each finding, file and refusal, one an audit for thin pages, missing values and images."""
    orders = table(spark, sf_dir, "orders").withColumn("audit_id", F.floor(F.col("o_orderkey") / 10).cast("string"))
    part = lambda where, *columns: orders.filter(where).select("audit_id", *columns)
    k, name = F.col("o_orderkey"), _text("x", F.col("o_orderkey"))
    thin = part("o_orderkey % 5 = 0", (k % 1000).cast("int").alias("page_no"), (F.col("o_custkey") % 3 > 0).alias("read"))
    regions = orders.groupBy("audit_id").agg((F.count_if(F.col("o_orderstatus") == "O")).alias("regions"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0)).alias("regions_read"), (F.min("o_custkey") % 2 == 0).alias("enabled"))
    return verify.manual_checks(
        _line_findings(spark, sf_dir), part("o_orderkey % 11 = 0", name.alias("file"), F.lit("r").alias("reason")), part("o_orderkey % 13 = 0", name.alias("file")), thin, part("o_orderkey % 3 = 0", name.alias("key")),
        part("o_orderkey % 23 = 0", name.alias("key"), F.lit("1").alias("value"), F.lit("Page 1").alias("location")), regions,
    ).select("audit_id", "kind", "level", "what")


def main_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three open findings of each customer, gravest first."""
    orders = table(spark, sf_dir, "orders")
    risk = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    findings = orders.select(F.col("o_custkey").cast("string").alias("audit_id"), F.col("o_orderkey").alias("seq"), risk.alias("risk"), F.when(F.col("o_orderkey") % 2 == 0, "consistent").otherwise("inconsistent").alias("status"), F.col("o_orderkey").cast("string").alias("display"))
    return score.dominant_issues(findings).select("audit_id", F.array_join("dominant", ",").alias("dominant"))


def _store(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Events as memory entries of their user: the type is what stayed open, and its hour a page."""
    events = table(spark, sf_dir, "events").filter(where)
    hour = F.hour("ts")
    return events.select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), "event_type").alias("fp"), F.lit("t").alias("title"), F.lit(1).alias("runs"), F.col("ts").alias("last_seen"), F.array("event_type").alias("unresolved"), F.create_map("event_type", F.array(hour)).alias("page_hints"),
        F.when(F.col("event_id") % 10 == 0, 0).otherwise(memory.SCHEME).alias("scheme"), "event_id", "user_id",
    )


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts by fingerprint: runs add up, the newest entry stays, entries of another scheme are as if they were not there."""
    old, new = _store(spark, sf_dir, "event_id % 2 = 0").drop("event_id", "user_id"), _store(spark, sf_dir, "event_id % 2 = 1").drop("event_id", "user_id")
    kept = memory.remember(old, new)
    prints = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.concat(F.lit("u"), "user_id", F.lit("-"), "event_type").alias("fp"))
    return memory.recall(kept, prints).select("fp", "runs", "last_seen", F.get("unresolved", F.lit(0)).alias("open"))


def folded_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's store keeps in detail, and the digest of what is folded: times and pages of each open key."""
    kept, folded = memory.split_capacity(_store(spark, sf_dir), keep=4, by=["user_id"])
    done = memory.digest(folded)
    often = memory.unresolved_statistics(kept, done, 100).withColumnRenamed("times", "over_all")
    return done.join(often, "key").select("key", "times", F.array_join("pages", ",").alias("pages"), "over_all")


def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions on places, names and numbers, over parts."""
    k, n = F.col("k"), F.col("n")
    place = F.when(k % 4 == 0, _text("src/train_", n, ".py:", k)).when(k % 4 == 1, _text("tests/a.py:", n)).when(k % 4 == 2, _text("cfg/options.yaml(config)")).otherwise(_text("nb.ipynb[cell", n, "]:L3"))
    name = F.when(k % 3 == 0, "args.Batch-Size").when(k % 3 == 1, " learning_rate ").otherwise("unheard of")
    return _parts(spark, sf_dir).select(
        "paper_id", V.location_file(place).alias("file"), V.location_line(place).alias("line"), V.location_page(_text("Page ", n, " · x")).alias("page"), V.is_aux(place).alias("aux"), V.evidence_score(place, F.lit(True)).cast("int").alias("weight"),
        V.canonical_key(name).alias("key"), V.general_number(n / 2).alias("shown"), V.occurrences(F.repeat(F.lit("abA"), n), F.lit("A")).alias("times"), V.numbers_equal(n.cast("double"), (n + k % 2).cast("double")).alias("same"),
        V.text_match(_text("ResNet-", n), F.lit("resnet 1")).alias("alike"), V.language_of(F.when(k % 2 == 0, "a/b.JL").otherwise("c.zip")).alias("language"), V.has_cjk(F.when(k % 2 == 0, "学习率").otherwise("rate")).alias("cjk"),
        V.region_key(_text("i", n).cast("binary"), F.lit("m"), F.lit("p")).alias("region"), V.is_plausible(F.lit("dropout"), (n / 40).cast("string")).alias("plausible"), trace.site_class(place).alias("site"),
    )


def explained_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of explanation of each finding, and the ratio of its values where it is large."""
    return explain.explanations(_findings(spark, sf_dir)).select("audit_id", "seq", "kind", "ratio", (F.length("explanation") > 0).alias("told"))


def excerpts_to_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that name an open parameter, until there are enough, and the pages to read again for it."""
    n = F.col("n")
    said = F.concat(F.repeat(F.lit("The momentum is what we tune here. "), n % 4), F.lit("Nothing else is said on it."))
    parts = _parts(spark, sf_dir)
    pages = _pages(parts, said, F.lit("A page with other things on it."), said, said, said)
    gaps = parts.select("paper_id", F.lit("momentum").alias("key"))
    quoted = explain.excerpts(pages, gaps)
    read = explain.pages_to_read(pages, gaps).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("page_no")), ",").alias("pages"))
    lines = F.size(F.split("excerpts", "\n"))
    return quoted.join(read.hint("merge"), "paper_id").select("paper_id", lines.alias("n"), F.substring_index(F.substring_index("excerpts", "]", 1), " ", -1).cast("int").alias("first"), F.regexp_extract("excerpts", r"(?s).*\[Page (\d+)\]", 1).cast("int").alias("last"), "pages")


def listed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each source's coverage with their numbers and lengths."""
    docs = table(spark, sf_dir, "documents")
    audits = docs.select(F.col("source").alias("audit_id"), F.col("source").alias("paper_id")).distinct()
    pages = docs.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_no"), "text")
    of = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    name = lambda df: df.withColumn("file", F.format_string("f%03d", "i"))
    kinds = audits.select("paper_id", of(17).alias("i")).select("paper_id", F.format_string("k%02d", "i").alias("key"))
    listed = explain.coverage_lists(audits, pages, kinds, name(audits.select("audit_id", of(25).alias("i"))), name(audits.select("audit_id", of(3).alias("i"))))
    return listed.select("audit_id", "list", "n", F.array_join("items", ",").alias("items"))


_NAMES = [
    numeric_claims, rejected_claims, text_claims, claimed_results, table_rows, mentioned_parameters, code_values, failed_code, aligned_parameters, conflicting_values,
    image_findings, gated_candidates, ladder_fills, checked_findings, snippets_show, audit_readiness, audit_coverage, carriers, effective_sites, patch_gates,
    cjk_claims, asked_and_answered, repeat_pack, manual_list, main_issues, remembered, folded_memory, value_functions,
    explained_findings, excerpts_to_quote, listed_coverage,
]
QUERIES = {f.__name__: f for f in _NAMES}

_P = "p AS (SELECT 'p' || p_partkey AS id, p_partkey AS k, p_size AS n, lpad(cast(p_size AS varchar), 2, '0') AS nn FROM part)"
_SIDES = """
c AS (SELECT cast(o_orderkey AS varchar) AS a, cast(o_orderkey % 50 + 1 AS int) AS v FROM orders WHERE o_orderkey % 7 <> 0),
l AS (SELECT cast(l_orderkey AS varchar) AS a, cast(l_quantity AS int) AS v, l_linenumber AS ln, CASE l_returnflag WHEN 'R' THEN 'train/f' WHEN 'A' THEN 'lib/f' ELSE 'tests/f' END || l_linenumber || '.py' AS f,
  CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 2 ELSE -3 END AS w FROM lineitem),
best AS (SELECT *, f || ':' || ln AS place FROM l WHERE w >= 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, ln, f || ':' || ln DESC, cast(v AS varchar) DESC) = 1),
kinds AS (SELECT a, count(DISTINCT v) AS m FROM l GROUP BY 1),
aligned AS (SELECT coalesce(c.a, b.a) AS a, c.v AS claimed, b.v AS coded, b.place, b.ln,
  CASE WHEN b.a IS NULL THEN 'missing_in_code' WHEN c.a IS NULL THEN 'missing_in_paper' WHEN c.v = b.v THEN 'consistent' ELSE 'inconsistent' END AS status,
  CASE WHEN b.a IS NULL OR c.a IS NULL THEN 'medium' WHEN c.v = b.v THEN 'none' WHEN m > 1 AND b.w < 6 THEN 'low' ELSE 'medium' END AS risk
  FROM c FULL OUTER JOIN best b ON c.a = b.a LEFT JOIN kinds ON kinds.a = b.a),
firsts AS (SELECT a, v, f, ln, f || ':' || ln AS place FROM l WHERE w >= 0 QUALIFY row_number() OVER (PARTITION BY a, v ORDER BY ln, f || ':' || ln) = 1),
clash AS (SELECT a, count(*) AS m, count(DISTINCT f) AS files, arg_min(v, (ln, place, cast(v AS varchar))) AS coded, min(ln) AS ln FROM firsts GROUP BY 1 HAVING count(*) > 1),
found AS (SELECT a, status, risk, claimed, coded, ln, false AS inner_ FROM aligned UNION ALL SELECT a, 'internal_inconsistent', CASE WHEN files = 1 THEN 'medium' ELSE 'low' END, NULL, coded, ln, true FROM clash),
findings AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY CASE risk WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, CASE WHEN inner_ THEN 0 ELSE 1 END) AS seq FROM found),
spots AS (SELECT DISTINCT a, f, ln, v, CASE WHEN regexp_matches(f, '^train') THEN 1 ELSE 1 END AS score FROM l),
placed AS (SELECT a, count(*) AS m, arg_min(v, (f, ln, cast(v AS varchar))) AS v, arg_min(f || ':' || ln, (f, ln, cast(v AS varchar))) AS place FROM spots GROUP BY 1),
traced AS (SELECT k.a, m, CASE WHEN m = 1 THEN v END AS v, CASE WHEN m = 1 THEN place END AS place, CASE WHEN m = 1 THEN 'high' ELSE 'none' END AS confidence
  FROM (SELECT DISTINCT a FROM findings WHERE status IN ('inconsistent', 'internal_inconsistent')) k LEFT JOIN placed p ON p.a = k.a)"""

ORACLES = {
    "numeric_claims": f"""
WITH {_P}, u AS (SELECT id, 'batch_size' AS key, cast(n AS varchar) AS raw FROM p UNION ALL SELECT id, 'epochs', cast(n + 1 AS varchar) FROM p UNION ALL SELECT id, 'momentum', '0.' || nn FROM p)
SELECT id AS owner_id, key, raw AS raw_value, cast(raw AS double) AS num, 2 AS page, 'Page 2' AS location, 'text' AS channel, false AS excluded FROM u""",
    "rejected_claims": f"""
WITH {_P}, u AS (SELECT id, CASE k % 6 WHEN 0 THEN 'batch_size' WHEN 1 THEN 'epochs' ELSE 'dropout' END AS key, CASE k % 6 WHEN 2 THEN '0.' || nn ELSE cast(n AS varchar) END AS value,
  CASE k % 6 WHEN 0 THEN '命中处位于参考文献条目, 疑似引用内容而非论文设置' WHEN 1 THEN '该数字是调整的间隔, 并非训练总轮数' WHEN 2 THEN '取值处在乘法公式里(两侧有 ×), 不是独立设置值, 已丢弃'
    WHEN 3 THEN '位于表格的多列取值中（表头后跟一串裸数字），无法确定哪一列对应本实验配置，已丢弃' ELSE '超出领域先验范围, 疑似错位抽取' END AS reason
  FROM p WHERE k % 6 < 4 OR (k % 6 = 4 AND n > 1))
SELECT id AS owner_id, key, value, 'Page 1' AS location, reason FROM u""",
    "text_claims": f"""
WITH {_P}, u AS (SELECT id, 'optimizer' AS key, ['Adam', 'SGD', 'RMSprop'][n % 3 + 1] AS raw FROM p UNION ALL SELECT id, 'model', 'ResNet-' || n FROM p UNION ALL SELECT id, 'dataset', ['MNIST', 'SVHN'][n % 2 + 1] FROM p)
SELECT id AS owner_id, key, raw AS raw_value, lower(raw) AS txt, 2 AS page FROM u""",
    "claimed_results": f"""
WITH {_P}, u AS (SELECT id, n + 0.5::double AS c, n + 0.5::double + k % 5 AS m FROM p WHERE k % 3 <> 0),
r AS (SELECT *, CASE WHEN m - c <= 0.01 * c THEN 'none' WHEN m - c >= 2 OR m - c >= 0.05 * c THEN 'high' ELSE 'medium' END AS risk FROM u)
SELECT id AS audit_id, 'result_accuracy' AS key, 'result' AS category, CASE WHEN risk = 'none' THEN 'consistent' ELSE 'inconsistent' END AS status, risk, 'confirmed' AS confidence, c AS claimed, m AS measured FROM r""",
    "table_rows": f"""
WITH {_P}, u AS (SELECT id, k, 'batch_size' AS key, cast(n AS varchar) AS raw, 1 AS line FROM p UNION ALL SELECT id, k, 'dropout', '0.' || nn, 2 FROM p UNION ALL SELECT id, k, 'momentum', '7', 3 FROM p UNION ALL SELECT id, k, 'optimizer', 'Adam W', 4 FROM p)
SELECT id AS owner_id, key, raw AS raw_value, try_cast(raw AS double) AS num, CASE WHEN key = 'optimizer' THEN 'adamw' END AS txt, 'Page 2 · 表格1' AS location, 2 AS page, line, 'table' AS channel, k % 5 = 0 AS excluded FROM u""",
    "mentioned_parameters": f"""
WITH {_P}, u AS (SELECT id, unnest(['momentum', 'weight_decay']) AS key, true AS open, 0 AS declared, 'About momentum' AS title FROM p WHERE n % 4 = 0
  UNION ALL SELECT id, unnest(['seed', 'batch_size']), false, 2, 'On seeds' FROM p WHERE n % 4 = 1 UNION ALL SELECT id, 'iterations', true, 0, 'Training iterations are many.' FROM p WHERE n % 4 = 3)
SELECT id AS paper_id, key, open, declared, title FROM u""",
    "code_values": f"""
WITH {_P}, u AS (SELECT id, 'batch_size' AS key, cast(n AS varchar) AS raw, 2 AS line FROM p WHERE k % 7 <> 0 UNION ALL SELECT id, 'learning_rate', cast(cast('0.' || nn AS double) AS varchar), 3 FROM p WHERE k % 7 <> 0
  UNION ALL SELECT id, 'momentum', '0.9', 3 FROM p WHERE k % 7 <> 0 UNION ALL SELECT id, 'optimizer', 'SGD', 3 FROM p WHERE k % 7 <> 0)
SELECT id AS owner_id, key, raw AS raw_value, try_cast(raw AS double) AS num, CASE WHEN key = 'optimizer' THEN 'sgd' END AS txt, 'train.py' AS file, line FROM u""",
    "failed_code": f"WITH {_P} SELECT id AS code_id, 'a/train.py' AS file, n + 1 AS lines FROM p WHERE k % 7 = 0",
    "aligned_parameters": f"""
WITH {_SIDES} SELECT a AS audit_id, 'batch_size' AS key, 'Batch Size' AS display, 'param' AS category, status, risk, CASE risk WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS risk_ord,
  cast(claimed AS varchar) AS claimed, cast(coded AS varchar) AS coded, place FROM aligned""",
    "conflicting_values": f"WITH {_SIDES} SELECT a AS audit_id, 'batch_size' AS key, 'internal_inconsistent' AS status, CASE WHEN files = 1 THEN 'medium' ELSE 'low' END AS risk, cast(coded AS varchar) AS first, least(m - 1, 3) AS more FROM clash",
    "image_findings": f"""
WITH {_P} SELECT id AS audit_id, 'batch_size' AS key, CASE WHEN k % 2 = 1 THEN 'missing_in_code' WHEN k % 4 = 0 THEN 'consistent' ELSE 'inconsistent' END AS status, CASE WHEN k % 4 = 0 THEN 'none' ELSE 'low' END AS risk,
  'inferred' AS confidence, cast(n AS varchar) AS seen, 'Page 3 · table' AS place, CASE WHEN k % 2 = 0 THEN cast(n + k % 4 AS varchar) END AS coded FROM p WHERE k % 3 <> 0 AND k % 5 <> 0""",
    "gated_candidates": f"""
WITH {_P}, u AS (SELECT id, (['batch_size', 'batch_size', 'batch_size', 'batch_size', 'dropout', 'optimizer', 'sigma_xy', 'batch_size', 'batch_size', 'batch_size', 'dropout', 'input_size'])[k % 12 + 1] AS key,
  (['', 'not_grounded', 'flattened_table', 'citation', 'semantic_trap', 'no_letter', 'distribution_call', 'range', 'not_numeric', 'not_shown', 'implausible', 'shape'])[k % 12 + 1] AS why FROM p)
SELECT id AS paper_id, key, why = '' AS ok, why FROM u""",
    "ladder_fills": f"""
WITH {_P} SELECT id AS paper_id, CASE WHEN k % 4 < 2 THEN cast(n AS varchar) END AS value, CASE WHEN k % 4 = 0 THEN 1 WHEN k % 4 = 1 THEN 2 END AS rung, k % 4 = 2 AS hint, k % 4 >= 2 AS unfilled FROM p WHERE true""",
    "checked_findings": f"WITH {_SIDES} SELECT a AS audit_id, status, seq, coalesce(ln, 0) <= 6 AS verified, coalesce(ln, 0) > 6 AS beyond FROM findings",
    "snippets_show": f"WITH {_P} SELECT id AS paper_id, k % 5 <> 4 AS shown FROM p",
    "audit_readiness": """
WITH f AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'data' ELSE 'param' END AS category, sum(CASE o_orderstatus WHEN 'F' THEN 15 WHEN 'O' THEN 8 ELSE 3 END) AS cost FROM orders WHERE NOT starts_with(o_orderpriority, '1') GROUP BY 1, 2),
g AS (SELECT c_custkey AS c, unnest(['env', 'data', 'param', 'record', 'result']) AS category FROM customer),
s AS (SELECT g.c, g.category, CASE g.category WHEN 'env' THEN CASE WHEN g.c % 5 = 0 THEN NULL WHEN g.c % 10 = 1 THEN 100 ELSE 60 END WHEN 'record' THEN CASE WHEN g.c % 4 = 0 THEN 100 END
  WHEN 'result' THEN NULL ELSE CASE WHEN cost IS NOT NULL THEN greatest(0, 100 - cost) END END AS score FROM g LEFT JOIN f ON f.c = g.c AND f.category = g.category)
SELECT cast(c AS varchar) AS audit_id, category, cast(score AS int) AS score, score IS NULL AS unverified FROM s
UNION ALL SELECT cast(c AS varchar), 'total', cast(round_even(avg(score), 0) AS int), false FROM s GROUP BY c""",
    "audit_coverage": """
WITH d AS (SELECT source, cast(regexp_extract(source, '([0-9]+)', 1) AS int) AS x, count(*) AS total, count(*) FILTER (length(trim(text)) < 120) AS thin, count(*) FILTER (length(trim(text)) >= 120 OR doc_id % 2 = 0) AS covered FROM documents GROUP BY 1, 2),
r AS (SELECT *, covered / total AS pr, CASE WHEN x % 2 = 0 THEN 3 ELSE 1 END AS valued FROM d),
s AS (SELECT *, greatest(10, 100 - CASE WHEN pr < 0.6 THEN 25 WHEN pr < 0.8 THEN 12 ELSE 0 END - least(30, 10 * (x % 5)) - CASE WHEN valued / 4 < 0.4 THEN 10 ELSE 0 END - CASE WHEN x % 6 = 0 THEN 20 ELSE 0 END) AS score FROM r)
SELECT source AS audit_id, total AS pages_total, thin AS pages_thin, covered AS pages_covered, 4 AS kinds_seen, valued AS kinds_valued, 6 - x % 5 AS code_ok, round_even(pr, 3) AS page_ratio, round_even(valued / 4, 3) AS kind_ratio,
  cast(score AS int) AS confidence_score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "carriers": f"""
WITH {_P}, u AS (SELECT id, k, 'epochs' AS key, k % 2 = 0 AS a, k % 3 = 0 AS b, k % 4 = 0 AS c, false AS d FROM p UNION ALL SELECT id, k, 'seed', false, false, k % 2 = 1, k % 5 = 0 FROM p)
SELECT id AS audit_id, key, CASE key WHEN 'seed' THEN 'Random Seed' ELSE 'Epochs' END AS display, a AS in_paper, b AS in_image, c AS in_code, d AS mentioned, CASE WHEN key = 'seed' THEN NULL WHEN k % 2 = 0 THEN 'table+text' ELSE 'vision' END AS channels FROM u WHERE a OR b OR c OR d""",
    "effective_sites": f"WITH {_SIDES} SELECT a AS audit_id, 'batch_size' AS key, cast(v AS varchar) AS verdict, place AS verdict_loc, confidence, coalesce(m, 0) AS n FROM traced",
    "patch_gates": f"""
WITH {_P} SELECT id AS audit_id, (['batch_size', 'batch_size', 'model', 'batch_size', 'batch_size', 'batch_size', 'batch_size', 'batch_size', 'batch_size', 'warmup', 'learning_rate', 'batch_size', 'batch_size'])[k % 13 + 1] AS key,
  CASE WHEN k % 13 = 0 THEN 'proposed' ELSE 'refused' END AS status,
  (['', 'not_inconsistent', 'not_config', 'multi_value', 'no_rootcause', 'no_paper_value', 'malformed', 'literal', 'bad_target', 'unit', 'type_int', 'token', 'token'])[k % 13 + 1] AS refuse_kind,
  CASE WHEN k % 13 = 0 THEN 'batch_size = ' || n || '  # not ' || n END AS after FROM p""",
    "cjk_claims": f"""
WITH {_P} SELECT id AS paper_id, unnest(['batch_size', 'learning_rate', 'momentum']) AS key, unnest([cast(n AS varchar), '0.' || nn, NULL]) AS raw_value FROM p WHERE k % 4 = 0
UNION ALL SELECT id, unnest(['epochs', 'weight_decay', 'seed']), unnest([cast(n AS varchar), '0.' || nn, NULL]) FROM p WHERE k % 4 = 1
UNION ALL SELECT id, unnest(['num_clusters', 'kill_radius', 'threshold']), unnest([CASE WHEN n > 1 THEN cast(n AS varchar) END, cast(n AS varchar), NULL]) FROM p WHERE k % 4 = 2  -- one cluster is out of range
UNION ALL SELECT id, unnest(['batch_size', 'momentum']), unnest([cast(n AS varchar), '0.' || nn]) FROM p WHERE k % 4 = 3""",
    "asked_and_answered": """
WITH l AS (SELECT cast(l_orderkey // 10 AS varchar) AS a, 'k' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key FROM lineitem WHERE l_partkey % 7 < 3),
o AS (SELECT cast(o_orderkey // 10 AS varchar) AS a, o_orderkey AS k, o_orderstatus AS s FROM orders),
q AS (SELECT a, 'conflict' AS kind, 0 AS priority, 'conflict::' || key AS qid FROM l
  UNION ALL SELECT a, 'missing_value', 1, 'missing::x' || k FROM o WHERE s = 'O' UNION ALL SELECT a, 'image_inferred', 2, 'vision::x' || k FROM o WHERE s = 'F'
  UNION ALL SELECT a, 'parse_failure', 3, 'parse::f' || k || '.py' FROM o)
SELECT a AS audit_id, kind, priority, qid, CASE WHEN priority <> 1 THEN 'yes ' || qid END AS answer, count(*) OVER (PARTITION BY a, kind) AS n FROM q""",
    "repeat_pack": f"""
WITH {_SIDES}, r AS (SELECT a, arg_min(claimed, seq) FILTER (claimed IS NOT NULL) AS p, arg_min(coded, seq) FILTER (coded IS NOT NULL) AS c, string_agg(status, '; ' ORDER BY seq) AS status, arg_min(risk, seq) AS risk FROM findings GROUP BY 1)
SELECT a AS audit_id, 'batch_size' AS key, cast(p AS varchar) AS paper_value, cast(c AS varchar) AS code_value, status, risk, CASE WHEN risk <> 'none' THEN 1 END AS rank FROM r""",
    "manual_list": """
WITH l AS (SELECT cast(l_orderkey // 10 AS varchar) AS a, 'k' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS d, l_partkey % 7 AS n, l_suppkey AS s, l_linenumber AS v FROM lineitem),
o AS (SELECT cast(o_orderkey // 10 AS varchar) AS a, o_orderkey AS k, 'x' || o_orderkey AS x, o_custkey AS c, o_orderstatus = 'O' AS open FROM orders),
thin AS (SELECT a, array_to_string(list_sort(list_distinct(list(k % 1000))), ', ') AS pages, array_to_string(list_sort(list_distinct(list(k % 1000) FILTER (c % 3 = 0))), ', ') AS unread FROM o WHERE k % 5 = 0 GROUP BY 1),
r AS (SELECT a, count(*) FILTER (open) AS n, count(*) FILTER (open AND c % 2 = 0) AS seen, min(c) % 2 = 0 AS enabled FROM o GROUP BY 1)
SELECT a AS audit_id, 'selfcheck' AS kind, 0 AS level, d || ': v' AS what FROM l WHERE s % 10 = 0
UNION ALL SELECT a, 'image_only', 1, d || ' @ p place' FROM l WHERE s % 9 = 0
UNION ALL SELECT a, 'unverifiable', 1, d || ': c' || v FROM l WHERE n = 3
UNION ALL SELECT a, 'contradiction', 1, d || ': n' FROM l WHERE n = 4
UNION ALL SELECT a, 'missing_in_paper', 2, d || ' @ c place' FROM l WHERE n = 5
UNION ALL SELECT a, 'missing_in_code', 1, d || ': p' || v FROM l WHERE n = 6
UNION ALL SELECT a, 'images_off', 1, cast(n AS varchar) FROM r WHERE n > 0 AND NOT enabled
UNION ALL SELECT a, 'images_over_budget', 2, seen || '/' || n FROM r WHERE enabled AND seen < n
UNION ALL SELECT a, 'failed_file', 1, x || ': r' FROM o WHERE k % 11 = 0
UNION ALL SELECT a, 'unsupported_file', 2, x FROM o WHERE k % 13 = 0
UNION ALL SELECT a, 'thin_pages', 1, 'Page ' || pages || '; unread ' || unread FROM thin WHERE coalesce(unread, '') <> ''
UNION ALL SELECT a, 'thin_pages_read', 2, 'Page ' || pages FROM thin WHERE coalesce(unread, '') = ''
UNION ALL SELECT a, 'no_value', 1, string_agg(DISTINCT x, ', ' ORDER BY x) FROM o WHERE k % 3 = 0 GROUP BY 1
UNION ALL SELECT a, 'rejected', 2, x || ' = 1 @ Page 1' FROM o WHERE k % 23 = 0""",
    "main_issues": """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 2 = 1)
SELECT cast(o_custkey AS varchar) AS audit_id, string_agg(cast(o_orderkey AS varchar), ',' ORDER BY o_orderkey) AS dominant FROM o WHERE rn <= 3 GROUP BY 1""",
    "remembered": """
SELECT 'u' || user_id || '-' || event_type AS fp, cast(sum(CASE WHEN event_id % 2 = 1 OR event_id % 10 <> 0 THEN 1 END) AS int) AS runs, max(ts) AS last_seen, event_type AS open
FROM events WHERE (event_id % 2 = 1 OR event_id % 10 <> 0) AND user_id % 3 = 0 GROUP BY user_id, event_type""",
    "folded_memory": """
WITH r AS (SELECT event_type AS key, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'u' || user_id || '-' || event_type) AS rn FROM events),
d AS (SELECT key, count(*) AS times, list_slice(list_sort(list_distinct(list(h))), 1, 12) AS pages FROM r WHERE rn > 4 GROUP BY 1), a AS (SELECT key, count(*) AS over_all FROM r GROUP BY 1)
SELECT key, times, array_to_string(pages, ',') AS pages, over_all FROM d JOIN a USING (key)""",
    "value_functions": f"""
WITH {_P} SELECT id AS paper_id, CASE k % 4 WHEN 0 THEN 'src/train_' || n || '.py' WHEN 1 THEN 'tests/a.py' WHEN 2 THEN 'cfg/options.yaml' ELSE 'nb.ipynb' END AS file,
  CASE k % 4 WHEN 0 THEN cast(k AS int) WHEN 1 THEN n END AS line, n AS page, k % 4 = 1 AS aux, CASE k % 4 WHEN 0 THEN 6 WHEN 1 THEN -3 WHEN 2 THEN 4 ELSE -3 END AS weight,
  CASE k % 3 WHEN 0 THEN 'batch_size' WHEN 1 THEN 'learning_rate' END AS key, CASE WHEN n % 2 = 0 THEN cast(n // 2 AS varchar) ELSE cast(n / 2 AS varchar) END AS shown, 2 * n AS times, k % 2 = 0 AS same,
  starts_with(cast(n AS varchar), '1') AS alike, CASE WHEN k % 2 = 0 THEN 'Julia' END AS language, k % 2 = 0 AS cjk, substr(sha1('i' || n || 'mp'), 1, 16) AS region, n <= 40 AS plausible,
  CASE k % 4 WHEN 0 THEN 'entry' WHEN 2 THEN 'config' ELSE 'other' END AS site FROM p""",
    "explained_findings": f"""
WITH {_SIDES}, e AS (SELECT a, seq, CASE status WHEN 'internal_inconsistent' THEN 'internal' WHEN 'inconsistent' THEN 'other' ELSE status END AS kind, claimed::double AS p, coded::double AS c FROM findings WHERE status <> 'consistent')
SELECT a AS audit_id, seq, kind, CASE WHEN kind = 'other' AND greatest(p, c) / least(p, c) >= 5 THEN greatest(p, c) / least(p, c) END AS ratio, true AS told FROM e""",
    "excerpts_to_quote": f"""
WITH {_P}, u AS (SELECT id, n % 4 AS m FROM p WHERE n % 4 > 0)
SELECT id AS paper_id, CASE m WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 6 END AS n, 1 AS first, CASE m WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS last, '1,3' AS pages FROM u""",
    "listed_coverage": """
WITH s AS (SELECT DISTINCT source FROM documents), t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE length(trim(text)) < 120),
n AS (SELECT unnest(range(1, 26)) AS i)
SELECT source AS audit_id, 'thin' AS list, count(*) AS n, string_agg(cast(doc_id AS varchar), ',' ORDER BY doc_id) FILTER (rn <= 20) AS items FROM t GROUP BY 1
UNION ALL SELECT source, 'open', 17, (SELECT string_agg('k' || lpad(cast(i AS varchar), 2, '0'), ',' ORDER BY i) FROM n WHERE i <= 15) FROM s
UNION ALL SELECT source, 'failed', 25, (SELECT string_agg('f' || lpad(cast(i AS varchar), 3, '0'), ',' ORDER BY i) FROM n WHERE i <= 20) FROM s
UNION ALL SELECT source, 'unsupported', 3, 'f001,f002,f003' FROM s""",
}
