"""Operator 12: url filters by rules, and by the ratio of two character models where no rule fits.

A rule is a host (with all its subdomains), the start of a path and a verdict; the longest that fits decides. The urls that rules decide
are the accepted and the rejected ones that two Markov models of bytes are learned from, ``host + path`` with marks for
start and end. Orders 0 to ``ORDER`` are mixed as Witten and Bell do, each by how much its context was seen, down to the equal share of all bytes. All urls that
rules decide are counted, in Spark, but for one in ``ASIDE`` by its hash, and every gram of up to ``ORDER`` + 1 bytes is in the model: up to ``MOST`` distinct ones are sent to the
workers, more lie in sorted hash arrays in the shared folder, which workers map into memory; the scores are the same. The others' verdict
comes from the difference of the two logarithms for each byte; the limit between accepted and rejected is where the shares of wrong verdicts among the urls set
aside, one share for each class, have the smallest sum.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits; the models judge the empty text. If rules accept
none or reject none, there is nothing to compare and all other urls are allowed. Repeated rows count each time; other columns are ignored; a
url of any length is judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import held, mix64, text_slices
from .session import bounded_batches, shared_folder, table
from .shared_arrays import HashTable, save, shard_bits, shard_file

#: (host, path, verdict) of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Bytes before a byte that its share may depend on (6 at most); grams of a model that is sent to workers; bytes of a shard of a larger one; urls of which one calibrates; steps of a score in a histogram.
ORDER, MOST, SHARD_BYTES, ASIDE, STEP = 5, 1 << 19, 32 << 20, 5, 0.002
#: Counts up to this number are told apart when the least count of a model is chosen, larger ones by their length in bits.
EXACT = 1000
_START, _END, _BYTES = 1, 3, 257
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + F.lit(3), F.length(url))).otherwise("")  # a null url has no mark
    no_query = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(no_query, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(no_query, F.length(host) + F.lit(1), F.length(no_query))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, of equally long ones that with the longer host; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for where, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the grams that end with each byte or end mark of the texts: their number of bytes and these, the last one lowest; and the text of each."""
    n, sizes = len(offsets) - 1, np.diff(offsets) + 1
    ends = np.cumsum(sizes + ORDER)
    flat = np.full(int(ends[-1]), _START, np.int64)
    row = np.repeat(np.arange(n), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(ends - sizes, sizes) + within
    last = within == sizes[row] - 1
    flat[at[~last]] = raw[: offsets[-1]]
    flat[at[last]] = _END
    total, out = np.zeros(len(at), np.int64), []
    for k in range(ORDER + 1):
        total = total | (flat[at - k] << (8 * k))
        out.append(total | ((k + 1) << 56))
    return out, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for start, stop, raw, offsets in text_slices(batch.column(0)):
            grams, row = _grams(raw, offsets)
            bad = blocked[start:stop][row]
            for k in grams:
                keys, at = np.unique(k, return_inverse=True)
                counts = [np.bincount(at[mask], minlength=len(keys)) for mask in (~bad, bad)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c.astype(np.int64)) for c in counts)], ["gram", "good", "bad"])


@dataclass
class Ratio:
    """Two models over one set of grams; both arrays of counts and of totals and kinds by context have a column each."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Ratio:
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        contexts, first = np.unique(grams & ~0xFF, return_index=True)
        return cls(grams, counts.astype(np.float64), contexts, np.add.reduceat(counts, first).astype(np.float64), np.add.reduceat(counts > 0, first, dtype=np.float64))

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of grams, and totals and kinds of their contexts."""
        place, where = (np.minimum(np.searchsorted(have, want), len(have) - 1) for have, want in ((self.grams, keys), (self.contexts, keys & ~0xFF)))
        known = (self.contexts[where] == (keys & ~0xFF))[:, None]
        return np.where((self.grams[place] == keys)[:, None], self.counts[place], 0), np.where(known, self.totals[where], 0), np.where(known, self.kinds[where], 0)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logarithm of accepted over rejected for each byte of each text."""
        grams, row = _grams(raw, offsets)
        share = np.full((len(row), 2), 1 / _BYTES)
        for keys in grams:
            keys, at = np.unique(keys, return_inverse=True)
            seen, total, kinds = (x[at] for x in self.found(keys))
            share = np.where(total > 0, (seen + kinds * share) / np.maximum(total + kinds, 1), share)
        difference = np.log(share[:, 0]) - np.log(share[:, 1])
        return np.bincount(row, weights=difference, minlength=len(offsets) - 1) / (np.diff(offsets) + 1)


class SharedRatio(Ratio):
    """Two models of any size, opened from the shared folder: grams with (good, bad), contexts with totals and kinds of both."""

    def __init__(self, folder: str, bits: int, shards: dict[str, list[int]]) -> None:
        self.tables = {name: HashTable(folder, name, bits, 64 - bits, at, 2 if name == "gram" else 4) for name, at in shards.items()}

    def _columns(self, name: str, keys: np.ndarray) -> np.ndarray:
        hashed = mix64(keys.astype(np.uint64))
        order = np.argsort(hashed)
        out = np.zeros((len(keys), self.tables[name].columns))
        out[order] = np.stack(self.tables[name].find(hashed[order]), axis=1)
        return out

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        contexts, at = np.unique(keys & ~0xFF, return_inverse=True)
        of = self._columns("context", contexts)[at]
        return self._columns("gram", keys), of[:, :2], of[:, 2:]


@dataclass
class Stored:
    """Where a ``SharedRatio`` lies."""

    folder: str
    bits: int
    shards: dict[str, list[int]]

    def open(self) -> SharedRatio:
        return held(("urls", self.folder), lambda: SharedRatio(self.folder, self.bits, self.shards))


def _stored(counts: DataFrame, n: int) -> Stored:
    """Write counts of ``n`` grams, and of their contexts, as shards by hash; each is written by one task. The hash of 64 bits is one to one."""
    folder, bits = shared_folder(counts.sparkSession, "urls"), shard_bits(n * 32, SHARD_BYTES)
    positive = lambda c: F.count_if(F.col(c) > 0)
    contexts = counts.groupBy(F.col("gram").bitwiseAND(F.lit(~0xFF)).alias("gram")).agg(F.sum("good").alias("a"), F.sum("bad").alias("b"), positive("good").alias("c"), positive("bad").alias("d"))
    shards = {}
    for name, rows in (("gram", counts.select("gram", "good", "bad")), ("context", contexts)):
        shards[name] = _written(rows, folder, name, bits)
    return Stored(folder, bits, shards)


def _written(rows: DataFrame, folder: str, name: str, bits: int) -> list[int]:
    columns = rows.columns[1:]

    def hashed(batches):
        for batch in batches:
            keys = mix64(batch.column(0).to_numpy().astype(np.uint64))
            shard = pa.array((keys >> np.uint64(64 - bits)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, pa.array(keys.view(np.int64)), *batch.columns[1:]], ["shard", "key", *columns])

    def write(batches):
        got = list(batches)  # one shard
        if sum(map(len, got)):
            shard, keys, *values = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(2 + len(columns)))
            for k in np.unique(shard):
                mine = shard == k
                order = np.argsort(keys[mine].view(np.uint64))
                save(folder, f"{name}-{k:07d}", shard_file(keys[mine].view(np.uint64)[order], [v[mine][order] for v in values], 64 - bits))
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32())], ["shard"])

    schema = ", ".join(["shard int", "key bigint", *(f"{c} bigint" for c in columns)])
    return [r[0] for r in rows.mapInArrow(hashed, schema).repartitionById(1 << bits, "shard").mapInArrow(write, "shard int").collect()]  # one row a shard


def fit(known: DataFrame, most: int | None = None, sent: int = MOST) -> Ratio | Stored | None:
    """The models of (text, blocked), counted in Spark, with all grams: up to ``sent`` come to the driver, more are stored. None if a class is empty.
    A caller may ask for the ``most`` frequent grams only; no query does."""
    bounded_batches(known.sparkSession)
    counts = known.select("text", "blocked").mapInArrow(_count, "gram bigint, good bigint, bad bigint").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = counts.withColumn("n", F.col("good") + F.col("bad")).persist()
    if most is None:
        n, *both = counts.agg(F.count("*"), F.sum("good"), F.sum("bad")).first()
        if not all(both):
            counts.unpersist()
            return None
        if n > sent:
            stored = _stored(counts, n)
            counts.unpersist()
            return stored
        most = n
    step = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(F.expr(f"{EXACT} + length(bin(n))"))
    sizes = {r["step"]: r["many"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("many"), F.min("n").alias("n")).collect()}
    least = None
    for s in sorted(sizes, reverse=True):  # the smallest step for which all above it fits
        if sum(m for k, m in sizes.items() if k >= s) > most:
            break
        least = s
    if least is None:
        counts.unpersist()
        return None
    kept = counts.filter(step >= least).select("gram", "good", "bad").toArrow()
    counts.unpersist()
    model = Ratio.of(kept.column("gram").to_numpy(), np.stack([kept.column(c).to_numpy() for c in ("good", "bad")], axis=1))
    return model if (model.counts.sum(axis=0) > 0).all() else None


def scored(texts: DataFrame, model: Ratio | Stored) -> DataFrame:
    """The rows of ``texts`` with ``score`` of their column ``text``."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        opened = sent.value.open() if isinstance(sent.value, Stored) else sent.value
        return pa.array(np.concatenate([opened.scores(raw, offsets) for _, _, raw, offsets in text_slices(column)] or [np.zeros(0)]))

    return texts.withColumn("score", score(F.col("text")))


def limit(judged: DataFrame) -> float:
    """The score above which urls are accepted, from (score, blocked): the middle of the first of the steps with the fewest wrong verdicts, a share for each class."""
    steps = judged.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.sum((~F.col("blocked")).cast("long")).alias("good"), F.sum(F.col("blocked").cast("long")).alias("bad")).orderBy("step").collect()
    good, bad = (np.array([r[c] for r in steps], np.float64) for c in ("good", "bad"))
    if not good.sum() or not bad.sum():
        return 0.0
    # all up to the k-th step are rejected
    wrong = np.concatenate(([0], np.cumsum(good))) / good.sum() + (bad.sum() - np.concatenate(([0], np.cumsum(bad)))) / bad.sum()
    k = int(np.argmin(wrong))
    below = (steps[k - 1]["step"] + 1) * STEP if k else steps[0]["step"] * STEP
    above = steps[k]["step"] * STEP if k < len(steps) else below
    return (below + above) / 2


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, most: int | None = None, sent: int = MOST) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url); score is null where there is no model."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("m", matched(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    known = urls.filter("m is not null").select("text", (F.col("m.verdict") == "block").alias("blocked"), (F.crc32(F.col("text").cast("binary")) % ASIDE == 0).alias("aside"))
    model = fit(known.filter("not aside"), most, sent)
    if model is None:
        judged, edge = urls.withColumn("score", F.lit(None).cast("double")), 0.0
    else:
        judged, edge = scored(urls, model), limit(scored(known.filter("aside"), model))
    verdict = F.coalesce("m.verdict", F.when(F.col("score") <= edge, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "score")


def op12_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))
