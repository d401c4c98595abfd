"""Converged readouts, mergeable moments, subset inversion, and packed arrays of their own length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.functions.moments import merged, weighted_moments
from poolweave.operators import design, readouts, resolution, signals
from poolweave.streaming import events as st


def labeled(spark, n, seed, labels=3, modalities=2, width=4):
    rng = np.random.default_rng(seed)
    tokens = rng.normal(size=(n, modalities, width)) * [1.0, 5.0, 0.2, 1.0]
    true = rng.normal(size=(labels, width))
    y = (rng.random((n, labels)) < 1 / (1 + np.exp(-tokens[:, 0] @ true.T + [0, 1, 3]))).astype(int)
    rows = [(i, i // 2, tokens[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, group_id long, tokens array<array<double>>, y array<int>"), tokens, y


def newton(x, y, posw, decay):
    """The optimum of one model, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p * (1 + (posw - 1) * y) - posw * y) / len(x) + decay * w
        h = (x * (p * (1 - p) * (1 + (posw - 1) * y))[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_readouts_reach_the_optimum(spark, seed):
    df, tokens, y = labeled(spark, 160, seed)
    rows, n = readouts.with_folds(df, 3)
    got = readouts.fit_converged(rows.repartition(5), n, 3, 2, 4, decay=1e-3)
    assert got.gradient < 1e-6 and got.passes < 300
    fold = {r["id"]: r["fold"] for r in rows.collect()}
    posw = np.clip((len(y) - y.sum(0)) / np.maximum(y.sum(0), 1), 1, 20)
    for f in range(n + 1):
        use = [i for i in range(160) if f == 0 or fold[i] != f - 1]
        for m in range(2):
            for c in range(3):
                want = newton(tokens[use][:, m], y[use][:, c], posw[c], 1e-3)
                assert np.allclose(got.weights[f, m, c], want, atol=2e-4)


def test_readouts_in_slices_and_of_one_class(spark, monkeypatch):
    df, _, _ = labeled(spark, 60, 3)
    df = df.withColumn("y", F.transform("y", lambda v: F.lit(0)))  # no positive at all
    rows, n = readouts.with_folds(df, 2)
    whole = readouts.fit_converged(rows, n, 3, 2, 4, decay=1e-2)
    monkeypatch.setattr(readouts, "PASS_BYTES", 1)
    sliced = readouts.fit_converged(rows, n, 3, 2, 4, decay=1e-2)
    assert whole.gradient < 1e-6 and np.allclose(whole.weights, sliced.weights, atol=1e-4)


def test_moments_keep_their_digits(spark):
    rows = [("a", 1e9 + i % 3, 1 + i % 2) for i in range(999)] + [("b", 5.0, 1), (None, 2.0, 1), (None, 4.0, 3), ("c", None, 1), ("d", 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, w int").repartition(7)
    got = {r["k"]: r for r in weighted_moments(df, ["k"], "x", "w").collect()}
    x, w = np.array([r[1] for r in rows[:999]]) - 1e9, np.array([r[2] for r in rows[:999]])
    mean = (x * w).sum() / w.sum()
    assert np.isclose(got["a"]["mean"] - 1e9, mean, atol=1e-6)
    assert np.isclose(got["a"]["m2"], (w * (x - mean) ** 2).sum(), rtol=1e-9)
    assert (got["b"]["n"], got["b"]["m2"]) == (1, 0) and (got[None]["mean"], got[None]["m2"]) == (3.5, 3.0)
    assert "c" not in got and "d" not in got
    assert np.isclose(weighted_moments(df.filter("k = 'a'"), ["k"], "x").first()["n"], 999)
    assert merged((0, 0.0, 0.0), (2, 1.0, 0.5)) == (2, 1.0, 0.5) and merged((1, 1e9, 0), (1, 1e9 + 2, 0)) == (2, 1e9 + 1, 2)


def test_stream_state_keeps_its_digits(spark):
    df = spark.createDataFrame([("a", 1e9 + i) for i in (0, 1, 2)], "k string, x double")
    r = st.moments_to_stats(st.running_moments(df, "k", "x"), "k", sample=True).first()
    assert np.isclose(r["std"], 1.0, rtol=1e-12) and np.isclose(r["mean"], 1e9 + 1, rtol=1e-15)


@pytest.mark.parametrize("m", [1, 3, 10])
def test_subset_inversion(spark, m):
    v = np.random.default_rng(m).normal(size=(3, 1 << m))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], ", ".join(["id long", *[f"v{c} double" for c in range(1 << m)]]))
    got = design.interactions(df, m).orderBy("id").collect()
    for c in {0, 1, (1 << m) - 1, 5 % (1 << m), 300 % (1 << m)}:
        want = sum((-1) ** (c.bit_count() - s.bit_count()) * v[:, s] for s in range(1 << m) if s & c == s)
        assert np.allclose([r[f"i{c}"] for r in got], want)
    assert np.allclose([sum(r[f"i{c}"] for c in range(1 << m)) for r in got], v[:, -1])


def test_packed_arrays_are_as_long_as_their_study(spark):
    leads = sorted(signals.LEADS, key=signals.LEADS.get)
    rows = [(1, leads[0], t, float(t)) for t in range(5)] + [(1, leads[1], 2, 7.0)] + [(2, leads[0], 40, 1.0)] + [(3, "no such lead", 3, 1.0)]
    df = spark.createDataFrame(rows, "study_id long, lead string, t int, mv double")
    got = {(r["study_id"], r["lead_index"]): r["mv"] for r in signals.packed(df).collect()}
    n = len(set(signals.LEADS.values()))
    assert len(got) == 3 * n and {len(got[1, i]) for i in range(n)} == {5} and {len(got[2, i]) for i in range(n)} == {41} and {len(got[3, i]) for i in range(n)} == {0}
    assert got[1, signals.LEADS[leads[0]]] == [0, 1, 2, 3, 4] and got[1, signals.LEADS[leads[1]]] == [0, 0, 7, 0, 0]
    assert {len(r["mv"]) for r in signals.packed(df, samples=3).collect()} == {3}


def test_budget_curve_per_arm(spark):
    curve = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 4.0), ("y", 5, 1.0), ("y", 9, 6.0)], "arm string, labeled long, value double")
    ceiling = spark.createDataFrame([(6.0,)], "ceiling double")
    got = {(r["arm"], r["labeled"]): r["gap_closed"] for r in resolution.budget_curve(curve, ceiling, "arm").collect()}
    assert got == {("x", 1): 0.0, ("x", 2): 0.5, ("y", 5): 0.0, ("y", 9): 1.0}
    assert [r["gap_closed"] for r in resolution.budget_curve(curve.filter("arm = 'x'").drop("arm"), ceiling).orderBy("labeled").collect()] == [0.0, 0.5]
