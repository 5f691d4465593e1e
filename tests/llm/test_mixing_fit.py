"""The rates of operator 4 against plain projected gradient run to its end, and against the optimum's conditions."""

from __future__ import annotations

import numpy as np
import pytest

from evidentia.llm import mixing


def members(spark, seed, size, soft):
    rng = np.random.default_rng(seed)
    share = rng.dirichlet(np.full(size, 0.4))
    n = rng.integers(0, 400, 600)
    p = np.array([rng.dirichlet(soft * np.eye(size)[k] * size + 0.05) for k in rng.choice(size, 600, p=share)])
    rows = [(int(i), int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))]
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p array<double>").repartition(3), n.astype(float), p


def plain(n, p, wanted, steps=20_000):
    """Projected gradient without acceleration."""
    natural = p.T @ n
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(0, r - p @ ((p.T @ (n * r) - wanted) / natural))
    return r


@pytest.mark.parametrize(("seed", "size", "soft"), [(1, 2, 20), (2, 4, 20), (3, 4, 1), (4, 7, 5)])
def test_fit_meets_targets(spark, seed, size, soft):
    member, n, p = members(spark, seed, size, soft)
    names = [f"d{k}" for k in range(size)]
    steps = mixing.fit_rates(member, names, None)
    r, _ = mixing.rates(p, steps)
    natural = p.T @ n
    wanted = np.sqrt(natural) / np.sqrt(natural).sum() * n.sum()
    best = plain(n, p, wanted)
    gap = lambda x: np.abs(p.T @ (n * x) - wanted).max() / n.sum()
    assert (r >= 0).all() and gap(r) <= max(mixing.EXACT, gap(best) + 1e-3) and len(steps) <= mixing.STEPS
    got = {x["doc_id"]: x["rate"] for x in member.select("doc_id", mixing.rate(member["p"], steps).alias("rate")).collect()}
    assert np.allclose([got[i] for i in range(len(n))], r)


def test_fit_of_targets_out_of_reach(spark):
    """Targets that no rates can meet: the weighted least-squares optimum, and a warning."""
    member, n, p = members(spark, 5, 3, 1)
    p = np.array([[0.6, 0.3, 0.1]] * 300 + [[0.2, 0.5, 0.3]] * 300)
    member = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens bigint, p array<double>")
    with pytest.warns(UserWarning, match="above or below"):
        steps = mixing.fit_rates(member, ["a", "b", "c"], {"a": 0.0, "b": 0.2, "c": 0.8})
    r, _ = mixing.rates(p, steps)
    natural = p.T @ n
    loss = lambda x: (((p.T @ (n * x)) - np.array([0.0, 0.2, 0.8]) * n.sum()) ** 2 / natural).sum()
    assert loss(r) <= loss(plain(n, p, np.array([0.0, 0.2, 0.8]) * n.sum())) * (1 + 1e-6) + 1e-9 and (r == 0).any()


def test_fit_of_nothing(spark):
    empty = spark.createDataFrame([], "n_tokens bigint, p array<double>")
    assert mixing.fit_rates(empty, ["a"], None) == []
    none = spark.createDataFrame([(0, [1.0]), (None, [1.0])], "n_tokens bigint, p array<double>")
    assert mixing.fit_rates(none, ["a"], {"a": 1.0}) == []


def test_whole_labelled_texts_count(spark):
    """What tells a text's domain may stand at its very end."""
    rows = [(i, "same " * 6000 + ("left " if i % 2 else "right ") * 40, "l" if i % 2 else "r") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = mixing.fit_classifier(docs, docs.select("doc_id"))
    for word, lang in ((b"left left left", "l"), (b"right right", "r")):
        _, p = model.posteriors(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        assert model.domains[int(p[0].argmax())] == lang and p.max() > 0.9
