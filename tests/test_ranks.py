"""Range-wise ranks against direct computation, with ties, hot keys and small ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolweave.functions import ranks


def frame(seed, n, hot):
    """A third or more of the rows share one key and one value."""
    rng = np.random.default_rng(seed)
    value = np.round(rng.normal(size=n), 2)
    value[rng.random(n) < hot] = 0.25
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n))
    return pd.DataFrame({"id": rng.permutation(n), "k": key, "v": value})


@pytest.mark.parametrize("seed,hot", [(0, 0.0), (1, 0.35), (2, 0.95)])
def test_row_ranks(spark, seed, hot):
    pdf = frame(seed, 900, hot)
    out = ranks.row_ranks(spark.createDataFrame(pdf), ["k"], "v", "id", descending=True, ranges=7).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).assign(r=lambda d: d.groupby("k").cumcount() + 1)
    got = out.set_index("id")["rank"]
    assert (got.loc[want["id"]].to_numpy() == want["r"].to_numpy()).all()


@pytest.mark.parametrize("seed,hot", [(3, 0.0), (4, 0.4)])
def test_rank_fraction(spark, seed, hot):
    pdf = frame(seed, 700, hot)
    out = ranks.rank_fraction(spark.createDataFrame(pdf), "v", "r", ranges=5).toPandas().set_index("id")["r"]
    want = pdf.set_index("id")["v"].rank(method="average") / len(pdf)
    assert np.allclose(out.sort_index(), want.sort_index())


def test_running_sums_and_quantiles(spark):
    pdf = frame(5, 800, 0.4)
    df = spark.createDataFrame(pdf).withColumn("n", F.lit(1).cast("bigint"))
    got = ranks.running_sums(df, ["k"], "v", ["n"], ranges=6).toPandas()
    for _, row in got.iterrows():
        mine = pdf[pdf["k"] == row["k"]]["v"]
        assert row["n_before"] == (mine < row["v"]).sum()
        assert row["n_all"] == len(mine)
    shares = spark.createDataFrame([(int(k), float(0.1 * k + 0.05)) for k in pdf["k"].unique()], "k int, share double")
    q = ranks.key_quantiles(df, ["k"], "v", shares, "share", "q").toPandas().set_index("k")["q"]
    for k in pdf["k"].unique():
        assert np.isclose(q[k], np.quantile(pdf[pdf["k"] == k]["v"], 0.1 * k + 0.05))


def test_take_top_past_the_limit(spark, monkeypatch):
    pdf = frame(6, 300, 0.3)
    df = spark.createDataFrame(pdf)
    small = ranks.take_top(df, "v", "id", 40).select("id", "rank").toPandas()
    monkeypatch.setattr(ranks, "TOP_LIMIT", 10)
    large = ranks.take_top(df, "v", "id", 40).select("id", "rank").toPandas()
    assert set(map(tuple, small.to_numpy())) == set(map(tuple, large.to_numpy()))


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert ranks.spearman(df, "a", "b").first()[0] is None


def gaps(n=400):
    rng = np.random.default_rng(9)
    values = [None if i % 5 == 0 else float("nan") if i % 7 == 0 else round(float(rng.normal()), 1) for i in range(n)]
    keys = [None if i % 3 == 0 else i % 2 for i in range(n)]
    return [(i, k, v) for i, (k, v) in enumerate(zip(keys, values))]


def place(row, descending):
    v = row[2]
    kind = 2 if v is None else 1 if v != v else 0
    return kind, (0 if kind else -v if descending else v), row[0]


@pytest.mark.parametrize("descending", [True, False])
def test_gaps_and_missing_keys_have_one_order(spark, monkeypatch, descending):
    rows = gaps()
    df = spark.createDataFrame(rows, "id long, k int, v double").repartition(5)
    want = [r[0] for r in sorted(rows, key=lambda r: place(r, descending))]
    for limit in (100_000, 10):
        monkeypatch.setattr(ranks, "TOP_LIMIT", limit)
        top = ranks.take_top(df, "v", "id", 390, descending).collect()
        assert [r.id for r in sorted(top, key=lambda r: r["rank"])] == want[:390]
    got = ranks.row_ranks(df, ["k"], "v", "id", descending=descending, ranges=6).collect()
    for key in (None, 0, 1):
        mine = [r for r in want if rows[r][1] == key]
        assert [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r["rank"])] == mine


def test_large_integers_keep_their_digits(spark):
    rows = [(i, 2**53 + (i * 7) % 5) for i in range(50)] + [(50, -(2**63)), (51, 2**63 - 1), (52, None)]
    df = spark.createDataFrame(rows, "id long, v long")
    for descending in (True, False):
        got = ranks.row_ranks(df, [], "v", "id", descending=descending, ranges=4).collect()
        want = sorted(rows, key=lambda r: (r[1] is None, (-1 if descending else 1) * (r[1] or 0), r[0]))
        assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want]


def test_rank_fraction_keeps_rows_with_gaps(spark):
    rows = gaps()
    df = spark.createDataFrame(rows, "id long, k int, v double")
    got = {r.id: r.f for r in ranks.rank_fraction(df, "v", "f", ["k"], ranges=5).collect()}
    assert len(got) == len(rows)
    for i, k, v in rows:
        if v is None:
            assert got[i] is None
            continue
        mine = [r[2] for r in rows if r[1] == k and r[2] is not None]
        less = sum(1 for w in mine if (w < v if v == v else w == w))
        same = sum(1 for w in mine if w == v or (w != w and v != v))
        assert np.isclose(got[i], (less + (same + 1) / 2) / len(mine))
