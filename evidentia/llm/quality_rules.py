"""Operator 3: quality rules as robust multivariate outliers, in DataFrame operations only.

Every text gives a vector of statistics, each transformed so that it has a like spread at every length:
the logarithm of its mean word length (drawn to 5 characters by 50 words), the root of its symbols per
word, its share of repeated lines, and its share of words in repeated windows. For each language and
source a minimum-covariance-determinant estimate is made of these by concentration steps: the half of the rows
with the smallest distance give a mean and a covariance (made consistent for the normal law and raised by a small
fixed spread, so that it is never singular), which give new distances. ``STARTS`` starts (medians with fixed spreads,
medians with quartile ranges, lower quartiles) make ``TRIALS`` steps each; that of the least determinant is kept in each
group, and goes on until the determinant settles (a warning tells if it does not). The estimate is then made once more from all rows within ``NEAR`` of it, as is usual, which is
more efficient and keeps the breakdown point of the half: near 50 %. A document is rejected when its squared Mahalanobis distance is beyond
``CUTOFF``, and also when it fails the base rules.

The half is cut on a histogram of the distances, whose bins are whole numbers: it merges map-side, is
bounded for each group, and gives the same rows whatever the partitioning. The rows of the bin that completes
the half count by the share of them that it takes, so that copies, which are in one bin, do not all come in. Only rows that pass the base
rules make an estimate. Groups with fewer than ``LEAST`` of them share the estimate of their language's small groups, these that of all small groups; below ``LEAST``
rows there is no estimate and nothing is rejected by it.

Defined cases: a null or empty text has no words and fails the base rules; a null language or source is a
group of its own; input columns beside doc_id, text, lang and source are ignored by the scores.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, table, without

WIDTH = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Squared distance that a normal vector of four exceeds once in 100,000.
CUTOFF = 28.47
SUBSET, LEAST = 0.5, 40
#: Squared distance within which a normal vector of four lies with the share ``NEAR_SHARE``.
NEAR, NEAR_SHARE = 11.143, 0.975
#: Starts of each group, steps before the best is kept.
STARTS, TRIALS = 3, 2
#: Most concentration steps; change in the logarithm of a determinant that counts as none.
STEPS, SETTLED = 40, 1e-3
#: Parts that the rows of a group are joined in.
SALTS = 32
#: Fixed spreads that are added to those estimated, in the order of the statistics.
FLOORS = (0.03, 0.06, 0.06, 0.05)
_P = len(FLOORS)
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _consistency(share: float) -> float:
    """Makes the covariance of the central ``share`` of a normal vector of four that of the whole."""
    at = lambda x, terms: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(terms))
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid, 2) < share else (low, mid)
    return share / at(low, 3)


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    def of(w: Column) -> Column:
        inner = F.slice(w, F.lit(1), F.size(w) - (WIDTH - 1))
        return F.transform(inner, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WIDTH)]))

    return F.when(F.size(words) >= WIDTH, _bound(words, of)).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more; ``hashes`` are those of the windows by their place."""
    placed = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))

    def repeated(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(ordered, other)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))

    places = F.array_sort(F.transform(_bound(F.array_sort(placed), repeated), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WIDTH).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WIDTH), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def row_digest() -> Column:
    """What tells the rows of one doc_id apart; rows that agree in it have the same verdict."""
    return F.xxhash64("text", "lang", "source")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row (a digest) and the base statistics of every row of ``docs``."""
    plain = docs.select("doc_id", "lang", "source", row_digest().alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    split = plain.select(
        "doc_id",
        "lang",
        "source",
        "row",
        F.length(F.translate("t", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0).alias("lines"),
        F.transform(word_list(F.col("t")), lambda x: F.xxhash64(x)).alias("w"),
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        "row",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("w")).alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_words(F.col("windows"))).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("n_repeat_words", repeated).drop("windows")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistic_vector() -> list[Column]:
    n = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 250) / (n + 50)),
        F.sqrt(F.col("n_symbols") / (n + 50)),
        F.col("n_dup_lines") / (F.col("n_lines") + 5),
        F.col("n_repeat_words") / (n + 50),
    ]


def _squared_distance(mean: list[Column], lower: list[list[Column]]) -> Column:
    """Mahalanobis distance by forward substitution in a Cholesky factor; columns x0.. are the vector."""
    solved: list[Column] = []
    for i in range(_P):
        rest = F.col(f"x{i}") - mean[i]
        for j in range(i):
            rest = rest - lower[i][j] * solved[j]
        solved.append(rest / lower[i][i])
    total = solved[0] * solved[0]
    for z in solved[1:]:
        total = total + z * z
    return total


def _with_factor(moments: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Means m0.. and Cholesky entries l00.. from the sums of the central ``share`` of the rows."""
    n = F.col("n")
    out = moments.select(*keys, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_P)], *[f"q{i}{j}" for i in range(_P) for j in range(i + 1)])
    scale = _consistency(share)
    for i in range(_P):
        for j in range(i + 1):
            value = scale * (F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 100))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keys, *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i in range(_P) for j in range(i + 1)])


def _spread(small: DataFrame) -> DataFrame:
    """A table of groups once for each salt: a group that holds a third of all rows is then joined in as many tasks."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distance(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    lower = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(_P)]
    drop = [c for c in estimates.columns if c not in keys]
    return rows.join(_spread(estimates), [*keys, "salt"], "left").withColumn("d2", _squared_distance([F.col(f"m{i}") for i in range(_P)], lower)).drop(*drop)


def _subset(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows up to the bin of distances that completes the share ``SUBSET`` of each group, with their weight: one,
    and in that bin the part of it that completes the share."""
    binned = rows.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 256).cast("int"))
    per_bin = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*keys).orderBy("bin")
    running = per_bin.select(*keys, "bin", "n", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    need = SUBSET * F.col("all") - (F.col("upto") - F.col("n"))
    limits = running.filter(F.col("upto") >= SUBSET * F.col("all")).groupBy(*keys).agg(F.min_by(F.struct(F.col("bin").alias("limit"), (need / F.col("n")).alias("part")), "bin").alias("x"))
    joined = binned.join(_spread(limits.select(*keys, "x.limit", "x.part")), [*keys, "salt"]).filter(F.col("bin") <= F.col("limit"))
    return joined.withColumn("weight", F.when(F.col("bin") == F.col("limit"), F.col("part")).otherwise(F.lit(1.0)))


def _determinant() -> Column:
    """The logarithm of an estimate's determinant."""
    return sum((2 * F.log(f"l{i}{i}") for i in range(_P)), F.lit(0.0))


def _starts(sound: DataFrame) -> DataFrame:
    """First estimates of the groups that have enough rows: mean and a diagonal factor for each start."""
    quarters = sound.groupBy("g").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i in range(_P)], F.count("*").alias("n_g")).filter(F.col("n_g") >= LEAST)
    at = lambda i, k: F.get(f"p{i}", F.lit(k))
    fixed = [F.lit(FLOORS[i] * 2) for i in range(_P)]
    ranges = [F.sqrt(((at(i, 2) - at(i, 0)) / 1.349) ** 2 + FLOORS[i] ** 2) for i in range(_P)]
    forms = [([at(i, 1) for i in range(_P)], fixed), ([at(i, 1) for i in range(_P)], ranges), ([at(i, 0) for i in range(_P)], fixed)]
    rows = [F.struct(F.lit(k).alias("start"), *[m[i].alias(f"m{i}") for i in range(_P)], *[(d[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(_P) for j in range(i + 1)]) for k, (m, d) in enumerate(forms[:STARTS])]
    return quarters.select("g", F.explode(F.array(*rows)).alias("e")).select("g", "e.*")


def _settled(before: DataFrame, after: DataFrame, keys: list[str]) -> bool:
    """Whether no group's determinant has changed."""
    size = lambda d: d.select(*keys, _determinant().alias("det"))
    both = size(before).withColumnRenamed("det", "was").join(size(after), keys)
    return (both.agg(F.max(F.abs(F.col("det") - F.col("was"))).alias("x")).first()["x"] or 0.0) <= SETTLED


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sums of each group."""
    w, x = F.col("weight"), [F.col(f"x{i}") for i in range(_P)]
    sums = [F.sum(w * x[i]).alias(f"s{i}") for i in range(_P)] + [F.sum(w * x[i] * x[j]).alias(f"q{i}{j}") for i in range(_P) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.sum(w).alias("n"), *sums)


def _pooled_groups(rows: DataFrame) -> DataFrame:
    """Group g of every row: its language and source, or the pool that its few rows share."""
    none = F.lit("\x00")
    salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")
    named = rows.withColumn("gl", F.coalesce("lang", none)).withColumn("gs", F.coalesce("source", none)).withColumn("salt", salt)
    counts = named.groupBy("gl", "gs").agg(F.count_if(~F.col("base_failed")).alias("n"))
    small = F.col("n") < LEAST
    by_lang = Window.partitionBy("gl")
    counts = counts.withColumn("n_lang", F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_lang))
    level = F.when(~small, F.concat(F.lit("s\x01"), "gl", F.lit("\x01"), "gs")).when(F.col("n_lang") >= LEAST, F.concat(F.lit("l\x01"), "gl")).otherwise(F.lit("a"))
    return named.join(_spread(counts.select("gl", "gs", level.alias("g"))), ["gl", "gs", "salt"]).drop("gl", "gs")


def robust_verdicts(stats: DataFrame) -> DataFrame:
    """Add base_failed, d2 and kept to the base statistics (which should be a table already: they are read often)."""
    rows = stats.select("*", base_failed().alias("base_failed"))
    rows = rows.select("*", *[x.alias(f"x{i}") for i, x in enumerate(statistic_vector())])
    grouped = cut(_pooled_groups(rows), "rules-groups")
    sound = grouped.filter(~F.col("base_failed"))
    keys = ["g", "start"]
    tried = sound.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    estimates = cut(_starts(sound), "rules-start")
    for trial in range(TRIALS):
        measured = _distance(tried, estimates, keys).filter(F.col("d2").isNotNull())
        estimates = cut(_with_factor(_moments(_subset(measured, keys), keys), keys, SUBSET), f"rules-trial{trial}")
    keys = ["g"]
    best = Window.partitionBy("g").orderBy(_determinant(), "start")
    estimates = cut(estimates.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "start"), "rules-best")
    for step in range(STEPS):
        measured = _distance(sound, estimates, keys).filter(F.col("d2").isNotNull())
        before, estimates = estimates, cut(_with_factor(_moments(_subset(measured, keys), keys), keys, SUBSET), f"rules-step{step}")
        if _settled(before, estimates, keys):
            break
    else:
        warnings.warn(f"quality rules: an estimate has not settled after {STEPS} steps", stacklevel=2)
    near = _distance(sound, estimates, keys).filter(F.col("d2") <= NEAR).withColumn("weight", F.lit(1.0))
    estimates = cut(_with_factor(_moments(near, keys), keys, NEAR_SHARE), "rules-near")
    verdict = _distance(grouped, estimates, keys)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return verdict.withColumn("kept", kept).drop("g", "salt", *[f"x{i}" for i in range(_P)])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept and the squared distance of every row of ``docs``."""
    return _verdicts(docs).select("doc_id", *_NAMES)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]


def _verdicts(docs: DataFrame) -> DataFrame:
    return robust_verdicts(cut(base_statistics(docs), "rules-stats"))


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Each row is judged by itself, also where rows share
    a doc_id or have none; the rejected ones are joined by doc_id and digest, so that no text moves while they are few."""
    gone = _verdicts(docs).filter(~F.col("kept")).select("doc_id", "row")
    return without(docs, gone, {"doc_id": F.col("doc_id"), "row": row_digest()}, "rules-rejected")


def op3_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))
