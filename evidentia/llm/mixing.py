"""Operator 4: mixing sources to target weights with soft domain membership.

The domains are the values of a column of all labelled documents, however many: the languages, or those of the
column that is named (a column that the text does not tell of, such as a random source, gives posteriors near
the prior, and its targets cannot be met). A classifier that is fitted on a
bounded sample of each domain's labelled documents, whole texts, counted in Spark, gives every document a posterior over the domains (naive Bayes over hashed words; the
evidence of a text counts as that of at most ``EVIDENCE`` words, so that membership stays soft). The rates r
are the nonnegative least-squares fit of

    sum_k (sum_d r_d n_d p_dk - T_k)^2 / (2 S_k),        S_k = sum_d n_d p_dk

by projected gradient steps on the rates of all documents, from rates of one: r <- max(0, y - p . (gap / S)), y = r + b (r - r before).
Dividing by the natural totals S makes one the greatest step that always descends (the rows of S^-1 sum_d n_d p_d p_d' are shares), however small a domain
is; b is Nesterov's, begun anew when a step goes uphill. A step needs the gap at y: one sum over all posteriors in Spark. A rate follows from its own posterior and the
gaps so far, a few numbers a step, so that no rates are stored. The steps end when no gap is above ``EXACT`` of all tokens; a warning names the gaps that
are above ``TOLERANCE`` when ``STEPS`` do not suffice (targets that no rates can meet). A document's
copies are its rate rounded by the hash of its id, so that expected domain totals meet the targets.

Defined cases: a null or empty text has no tokens and the prior as posterior; without labelled rows there
is one domain "all"; a target for a domain without tokens cannot be met, which is warned of; one for a domain
without labelled documents is an error; a domain without a given target has the target zero;
a null id is rounded like any other. Columns beside doc_id, text and the domain's are passed on by ``mix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import held, text_slices, word_pieces
from .session import bounded_batches, cut, small_table, table

#: Labelled rows that the classifier is fitted on, and those that each domain has at least where it has as many.
SAMPLE, LEAST = 3000, 40
FEATURES, EVIDENCE = 1 << 14, 40
#: Share of all tokens that a gap may have, and below which the steps end; most steps.
TOLERANCE, EXACT, STEPS = 1e-3, 1e-5, 200


class DomainClassifier:
    def __init__(self, domains: list[str], prior: np.ndarray, weights: np.ndarray) -> None:
        self.domains, self.prior, self.weights = domains, prior, weights

    @classmethod
    def of(cls, totals: dict[str, np.ndarray], counts: dict[str, int]) -> DomainClassifier:
        """From counts of hashed words by domain; ``counts`` are the labelled rows of every domain."""
        names = sorted(counts, key=lambda x: (-counts[x], x))
        if not names:
            return cls(["all"], np.zeros(1), np.zeros((FEATURES, 1)))
        total = np.stack([totals.get(n, np.zeros(FEATURES)) for n in names], axis=1)
        prior = np.array([counts[n] for n in names], dtype=float)
        share = (total + 0.5) / (total + 0.5).sum(axis=0)
        return cls(names, np.log(prior / prior.sum()), np.log(share))

    def posteriors(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and its posterior."""
        rows = len(offsets) - 1
        n, logit = np.zeros(rows, np.int64), np.zeros((rows, len(self.domains)))
        for word, row, _, _ in word_pieces(raw, offsets, True):
            n += np.bincount(row, minlength=rows)
            feature = (word & np.uint64(FEATURES - 1)).astype(np.int64)
            for k in range(len(self.domains)):  # one domain at a time: memory does not grow with their number
                logit[:, k] += np.bincount(row, self.weights[feature, k], rows)
        logit *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
        logit += self.prior
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return n, p / p.sum(axis=1, keepdims=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed words by domain, of batches (domain, text)."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        where = names.indices.to_numpy()
        for start, stop, raw, offsets in text_slices(batch.column(1)):
            for word, row, _, _ in word_pieces(raw, offsets, True):
                key = where[start:stop][row] * FEATURES + (word & np.uint64(FEATURES - 1)).astype(np.int64)
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys // FEATURES)).cast(pa.string()), pa.array((keys % FEATURES).astype(np.int32)), pa.array(n)], ["lang", "feature", "n"])


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> DomainClassifier:
    """Fit on about ``SAMPLE`` labelled documents, chosen by a hash of their id, ``LEAST`` of a domain or all it has; their texts are
    read whole. The domains and their priors are those of all labelled documents."""
    bounded_batches(docs.sparkSession)
    fits = docs.select("doc_id", "text", F.col(domain).cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null")
    ids = labels.select("doc_id").filter("doc_id is not null").distinct()
    langs = cut(fits.select("doc_id", "lang").join(ids, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang")), "mix-labelled")
    counts = {r["lang"]: r["n"] for r in langs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return DomainClassifier.of({}, {})
    every = sum(counts.values())
    share = small_table(docs.sparkSession, [(d, min(1.0, max(SAMPLE / every, LEAST / n))) for d, n in counts.items()], "lang string, share double")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = langs.join(F.broadcast(share), "lang").filter(hashed < F.col("share")).select("doc_id", "lang")
    known = small_table(docs.sparkSession, chosen.collect(), "doc_id bigint, lang string")  # about SAMPLE ids
    rows = fits.join(F.broadcast(known), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = rows.select("lang", "text").mapInArrow(_count_words, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()  # as many as the model has weights
    totals = {}
    for lang, feature, n in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True):
        totals.setdefault(lang, np.zeros(FEATURES))[feature] = n
    return DomainClassifier.of(totals, counts)


def membership(text: Column, shared) -> Column:
    """A struct of n (tokens) and p (share of each domain) of a text; ``shared`` is a broadcast classifier of fixed size."""

    @F.arrow_udf("struct<n:bigint,p:array<double>>")
    def of(column: pa.Array) -> pa.Array:
        held("domains", lambda: None)  # other operators' models go
        model = shared.value
        parts = [model.posteriors(raw, offsets) for _, _, raw, offsets in text_slices(column)]
        n = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
        p = np.concatenate([x for _, x in parts]) if parts else np.zeros((0, len(model.domains)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(model.domains), pa.int32()), pa.array(p.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], ["n", "p"])

    return of(text)


def memberships(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens and p of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", membership(F.col("text"), shared).alias("m")).select("doc_id", F.col("m.n").alias("n_tokens"), "m.p")


#: Steps of the fit: the weight of the last move, and for each domain what its gap takes from the rates.
Steps = list[tuple[float, np.ndarray]]


def rates(p: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """The rates of posteriors after some steps, and those before the last step."""
    now = before = np.ones(len(p))
    for weight, pull in steps:
        now, before = np.maximum(0, now + weight * (now - before) - p @ pull), now
    return now, before


def _rated(p: np.ndarray, steps: Steps) -> pa.Array:
    return pa.array(rates(p, steps)[0], pa.float64())


def rate(p: Column, steps: Steps) -> Column:
    """The rate of a posterior."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return _rated(np.asarray(column.flatten()).reshape(len(column), -1), steps)

    return of(p)


def text_rate(text: Column, shared, steps: Steps) -> Column:
    """The rate of a text, classified and rated by one worker."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        held("domains", lambda: None)
        found = [_rated(shared.value.posteriors(raw, offsets)[1], steps) for _, _, raw, offsets in text_slices(column)]
        return pa.concat_arrays(found) if found else pa.array([], pa.float64())

    return of(text)


def _sums(member: DataFrame, steps: Steps, weight: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows: tokens of each domain at the rates, and at the rates moved on by ``weight``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * size)
        for batch in batches:
            n = np.asarray(batch.column(0).fill_null(0), np.float64)
            p = np.asarray(batch.column(1).flatten()).reshape(-1, size)
            r, before = rates(p, steps)
            out += np.concatenate((p.T @ (n * r), p.T @ (n * (r + weight * (r - before)))))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(out)), pa.int32()), "v": pa.array(out, pa.float64())})

    rows = member.select("n_tokens", "p").mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 2 K numbers
    out = np.zeros(2 * size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out[:size], out[size:]


def fit_rates(member: DataFrame, domains: list[str], targets: dict[str, float] | None) -> Steps:
    """The steps that lead to the rates, ``domains`` being those of all labelled rows. ``targets`` are the domains' shares of all tokens (default: equal parts of their square roots)."""
    unknown = sorted(set(targets or ()) - set(domains))
    if unknown:
        raise ValueError(f"targets for domains without labelled documents: {unknown}")
    cells = cut(member.select("n_tokens", "p"), "mix-cells")
    natural, _ = _sums(cells, [], 0.0, len(domains))
    every = natural.sum()
    if not every:
        return []
    shares = np.array([targets.get(d, 0.0) if targets else np.sqrt(s) for d, s in zip(domains, natural, strict=True)])
    if not shares.sum():
        return []
    wanted = shares / shares.sum() * every
    scale = np.where(natural > 0, 1 / np.where(natural > 0, natural, 1), 0)
    loss = lambda total: float(((total - wanted) ** 2 * scale).sum())
    steps, age, last = [], 0, loss(natural)
    now = natural
    while np.abs(now - wanted).max() > EXACT * every and len(steps) < STEPS:
        weight = age / (age + 3)
        now, ahead = (now, now) if not steps else _sums(cells, steps, weight, len(domains))
        if loss(now) > last:  # uphill: the next move begins without the last one's weight
            age, weight, ahead = 0, 0.0, now
        last = loss(now)
        if np.abs(now - wanted).max() <= EXACT * every:
            break
        steps.append((weight, (ahead - wanted) * scale))
        age += 1
        if len(steps) == STEPS:
            now, _ = _sums(cells, steps, 0.0, len(domains))
    gaps = {d: float(x) for d, x in zip(domains, (now - wanted) / every, strict=True) if abs(x) > TOLERANCE}
    if gaps:
        warnings.warn(f"mixing: after {len(steps)} steps shares of all tokens are above or below their targets: {gaps}", stacklevel=2)
    return steps


def copies(rate_of: Column, doc_id: Column) -> Column:
    """A rate rounded by the hash of an id."""
    share = (F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(1 << 20)) / (1 << 20)).cast("double")
    return F.floor(rate_of + share).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate and copies of every row of ``docs``."""
    classifier = fit_classifier(docs, labels, domain)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    member = cut(memberships(docs, shared), "mix-members")
    steps = fit_rates(member, classifier.domains, targets)
    names = F.array(*map(F.lit, classifier.domains))
    likely = F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1)
    out = member.select("doc_id", "n_tokens", likely.alias("domain"), rate(F.col("p"), steps).alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """Every row of ``docs`` as many times as its copies say, with its own columns. A rate is a function of the posterior
    alone, so that the texts are classified once more where they are, and no text is shuffled."""
    names = docs.columns
    classifier = fit_classifier(docs, labels, domain)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    steps = fit_rates(memberships(docs, shared), classifier.domains, targets)
    placed = docs.withColumn("_copies", copies(text_rate(F.col("text"), shared, steps), F.col("doc_id")))
    # no filter on the copies: it would be pushed below and classify the texts twice
    times = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies")))
    return placed.withColumn("_copy", F.explode(times)).select(*names)


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for the default targets."""
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
