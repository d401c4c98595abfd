"""Metrics against direct numpy computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.operators import ranking_metrics as rm, resolution as rs, threshold_metrics as tm

N, C = 120, 6


def data(seed=0, ties=True):
    rng = np.random.default_rng(seed)
    y = (rng.random((N, C)) < np.array([0.5, 0.3, 0.2, 0.1, 0.05, 0.0])).astype(int)
    p = rng.random((N, C)) * 0.7 + 0.3 * y
    return y, np.round(p, 2) if ties else p


def cells(spark, y, p):
    rows = [(i, f"l{j}", j, int(y[i, j]), float(p[i, j])) for i in range(len(y)) for j in range(y.shape[1])]
    return spark.createDataFrame(rows, "id long, label string, ord int, y int, p double")


def average_precision(y, p):
    total, out, last = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = y[p >= t].sum()
        out += (tp / total - last) * tp / (p >= t).sum()
        last = tp / total
    return out


def auroc(y, p):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()) / (len(a) * len(b))


def test_areas_with_ties(spark):
    y, p = data()
    got = {r["label"]: r for r in rm.label_areas(cells(spark, y, p)).collect()}
    for j in range(C - 1):
        assert got[f"l{j}"]["auprc"] == pytest.approx(average_precision(y[:, j], p[:, j]))
        assert got[f"l{j}"]["auroc"] == pytest.approx(auroc(y[:, j], p[:, j]))
    assert got["l5"]["auprc"] is None and got["l5"]["auroc"] is None
    row = rm.ranking_metrics(cells(spark, y, p)).first()
    assert row["micro_auroc"] == pytest.approx(auroc(y.ravel(), p.ravel()))
    assert row["micro_auprc"] == pytest.approx(average_precision(y.ravel(), p.ravel()))
    assert (row["labels"], row["labels_auprc"], row["labels_auroc"]) == (6, 5, 5)


def test_undefined_metrics_are_an_error(spark):
    y, p = data()
    with pytest.raises(Exception, match="undefined"):
        rm.ranking_metrics(cells(spark, y * 0, p)).collect()
    with pytest.raises(Exception, match="without positive"):
        rm.recall_at(cells(spark, y * 0, p), [3]).collect()


def recall(y, p, k):
    top = np.argsort(-p, axis=1, kind="stable")[:, :k]
    keep = y.sum(1) > 0
    return (np.take_along_axis(y, top, 1).sum(1)[keep] / y.sum(1)[keep]).mean()


def test_recall_with_stable_ties(spark):
    y, p = data(1)
    got = {r["k"]: r["recall"] for r in rm.recall_at(cells(spark, y, p), [1, 3, 9], "drop").collect()}
    for k in (1, 3, 9):
        assert got[k] == pytest.approx(recall(y, p, min(k, C)))


def f1(y, hit):
    d = y.sum() + hit.sum()
    return 0.0 if d == 0 else 2 * (y * hit).sum() / d


def test_thresholds_and_rates(spark):
    y, p = data(2)
    grid = np.linspace(0, 1, 26)
    th = tm.fit_thresholds(cells(spark, y, p))
    got = {r["label"]: r["threshold"] for r in th.collect()}
    for j in range(C):
        if y[:, j].min() == y[:, j].max():
            assert got[f"l{j}"] == 0.5
            continue
        s = np.array([f1(y[:, j], p[:, j] >= t) for t in grid])
        best = np.flatnonzero(s == s.max())
        assert got[f"l{j}"] == pytest.approx(grid[best[np.argmin(np.abs(grid[best] - 0.5))]])
    t = np.array([got[f"l{j}"] for j in range(C)])
    hit = p >= t
    row = tm.all_metrics(cells(spark, y, p), th).first()
    assert row["macro_f1"] == pytest.approx(np.mean([f1(y[:, j], hit[:, j]) for j in range(C)]))
    assert row["micro_f1"] == pytest.approx(f1(y.ravel(), hit.ravel()))
    assert row["subset_accuracy"] == pytest.approx((hit == y).all(1).mean())
    assert row["hamming_loss"] == pytest.approx((hit != y).mean())


def test_bootstrap_interval_is_close_to_resampling(spark):
    y, p = data(3, ties=False)
    _, q = data(4, ties=False)
    pairs = rs.paired_rows(cells(spark, y, p), cells(spark, y, q), 2)
    got = rs.paired_interval(pairs, 2000, 7).first()
    d = np.array([r["diff"] for r in pairs.collect()])
    rng = np.random.default_rng(0)
    means = rng.choice(d, (4000, len(d))).mean(1)
    assert got["mean"] == pytest.approx(d.mean(), abs=0.01)
    assert got["low"] == pytest.approx(np.quantile(means, 0.025), abs=0.02)
    assert got["high"] == pytest.approx(np.quantile(means, 0.975), abs=0.02)
    again = rs.paired_interval(pairs.repartition(11), 2000, 7).first()
    assert again["low"] == pytest.approx(got["low"])


def test_poisson_weights():
    w = rs.poisson_weights(np.arange(20_000), 20, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (w == rs.poisson_weights(np.arange(20_000), 20, 3)).all()


@pytest.mark.parametrize("low,high,reach,want", [(-0.1, 0.1, 0.05, "unresolved"), (0.01, 0.09, 0.05, "marginal"), (0.09, 0.11, 0.1, "resolvable")])
def test_verdicts(spark, low, high, reach, want):
    i = spark.createDataFrame([(0.0, low, high)], "mean double, low double, high double")
    a = spark.createDataFrame([(reach,)], "achievable double")
    assert rs.verdict(i, a).first()["verdict"] == want


def test_curves_need_one_metric(spark):
    c = spark.createDataFrame([("a", 10, 0.5, "m"), ("a", 20, 0.7, "m"), ("b", 10, 0.4, "m")], "arm string, labeled long, value double, metric string")
    got = {r["arm"]: r["normalised_area"] for r in rs.compare_curves(c).collect()}
    assert got == {"a": pytest.approx(0.6), "b": 0.4}
    with pytest.raises(ValueError):
        rs.compare_curves(c.withColumn("metric", F.when(F.col("arm") == "a", "m").otherwise("n")))


def test_flatten_drops_arrays(spark):
    df = spark.sql("select 'x' as strategy, named_struct('recall_at_30', 0.75D, 'per', array(1)) as test")
    assert rs.flatten_metrics(df).columns == ["strategy", "test.recall_at_30"]


def test_scores_are_shuffled_once_and_ties_count_half(spark):
    rng = np.random.default_rng(5)
    y = (rng.random((60, 4)) < 0.4).astype(int)
    p = rng.integers(0, 6, (60, 4)) / 5  # every score is shared, in a label and between labels
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rm.ranking_metrics(cells(spark, y, p))
        plan = found._jdf.queryExecution().executedPlan().toString()
        row = found.first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_COL") == 1

    def areas(y, p):
        pos, neg = p[y == 1], p[y == 0]
        auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
        return np.mean([(pos >= v).sum() / (p >= v).sum() for v in pos]), auc

    per = np.array([areas(y[:, i], p[:, i]) for i in range(4)])
    expected = [*per.mean(0), *areas(y.ravel(), p.ravel())]
    np.testing.assert_allclose([row.macro_auprc, row.macro_auroc, row.micro_auprc, row.micro_auroc], expected, rtol=1e-12)


def test_cells_are_made_once_for_both_kinds_of_metrics(spark):
    y, p = data()
    y[:, 0] = 1
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = cells(spark, y, p).mapInArrow(count, "id long, label string, ord int, y int, p double")
    assert rm.task_metrics(made, "diagnoses").count() == 5
    assert seen.value == N * C
