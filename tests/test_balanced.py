"""Balanced folds, iterative stratification and exact bootstrap draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.operators import resolution, splits


def sequential(sizes, folds):
    loads, out = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        out.append((size, f))
        loads[f] += size
    return out, loads


@pytest.mark.parametrize("seed", range(30))
def test_size_classes_equal_the_sequential_rule(seed):
    rng = np.random.default_rng(seed)
    folds = int(rng.integers(2, 8))
    sizes = rng.choice([1, 2, 3, 7, 20, 100], int(rng.integers(1, 200)), p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]).tolist()
    want, loads = sequential(sizes, folds)
    values, counts = np.unique(sizes, return_counts=True)
    dealt, got_loads = splits.place_classes(list(zip(values[::-1].tolist(), counts[::-1].tolist())), folds)
    got = []
    for c, n in zip(dealt, counts[::-1].tolist()):
        for place in range(n):
            at, cycle = [x for x in c.cycles if x[0] <= place][-1]
            got.append((c.size, cycle[(place - at) % len(cycle)]))
    assert got == want and got_loads == loads


@pytest.mark.parametrize("parts", [1, 7])
def test_balanced_folds_whatever_the_partitions(spark, parts):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.choice([1, 1, 1, 2, 5, 60], 400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "g long, size long").repartition(parts)
    got = {r["g"]: r["fold"] for r in splits.balanced_folds(df, "g", "size", 4).collect()}
    order = sorted(range(400), key=lambda i: (-sizes[i], i))
    want, _ = sequential(sizes, 4)
    assert [got[i] for i in order] == [f for _, f in want]


def table(spark, n, rates, seed):
    rng = np.random.default_rng(seed)
    has = rng.random((n, len(rates))) < rates
    has[:, 1] |= has[:, 0] & (rng.random(n) < 0.8)  # labels that come together
    groups = spark.createDataFrame([(i,) for i in range(n)], "group_id long")
    rows = [(i, f"l{j}") for i in range(n) for j in range(len(rates)) if has[i, j]]
    return groups, spark.createDataFrame(rows, "group_id long, label string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_iterative_split_is_closer_than_hash_order(spark, seed):
    groups, positives = table(spark, 600, [0.02, 0.05, 0.3, 0.004, 0.5], seed)
    worst = lambda s: splits.share_deviation(s, positives).agg(F.max("deviation")).first()[0]
    own = splits.iterative_split(groups.repartition(5), positives, seed)
    rows = {r["group_id"]: r["partition"] for r in own.collect()}
    assert len(rows) == 600 == own.count()
    assert worst(own) <= worst(splits.group_split(groups, positives, seed))
    again = {r["group_id"]: r["partition"] for r in splits.iterative_split(groups.repartition(2), positives.repartition(3), seed).collect()}
    assert rows == again
    sizes = [sum(v == n for v in rows.values()) for n in ("train", "val", "test")]
    assert abs(sizes[0] - 360) <= 6 and abs(sizes[1] - 120) <= 6


def test_iterative_split_without_labels(spark):
    groups = spark.createDataFrame([(i,) for i in range(10)], "group_id long")
    none = spark.createDataFrame([], "group_id long, label string")
    got = [r["partition"] for r in splits.iterative_split(groups, none, 4).collect()]
    assert sorted(got) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2
    assert splits.iterative_split(groups.limit(0), none, 4).count() == 0


def test_every_draw_has_as_many_rows_as_there_are(spark):
    n, draws = 1500, 200
    values = np.random.default_rng(5).normal(size=n)
    pairs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, diff double")
    got = resolution.multinomial_draws(pairs.repartition(6), draws, 9, bucket=100).collect()
    assert len(got) == draws and all(r["items"] == n for r in got)
    means = np.array([r["mean_diff"] for r in got])
    spread = values.std() / np.sqrt(n)  # of the mean of n draws
    assert abs(means.mean() - values.mean()) < 4 * spread / np.sqrt(draws)
    assert 0.85 < means.std() / spread < 1.15
    again = resolution.multinomial_draws(pairs.repartition(2), draws, 9, bucket=100).collect()
    assert sorted((r["draw"], round(r["mean_diff"], 12)) for r in got) == sorted((r["draw"], round(r["mean_diff"], 12)) for r in again)


def test_tree_gives_a_multinomial():
    """Numbers of all buckets add up, and have the mean and the variance of a multinomial."""
    bounds = np.cumsum([0, 10, 0, 30, 5, 55])
    counts = np.stack([resolution._taken(bounds, b, 4000, 100, 3) for b in range(5)])
    assert (counts.sum(0) == 100).all() and (counts[1] == 0).all()
    for b, p in ((0, 0.1), (2, 0.3), (4, 0.55)):
        assert abs(counts[b].mean() - 100 * p) < 0.4
        assert 0.9 < counts[b].var() / (100 * p * (1 - p)) < 1.1


def test_interval_of_a_known_case(spark):
    pairs = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, diff double")
    for weights in ("multinomial", "poisson"):
        r = resolution.paired_interval(pairs, 20, 1, weights).first()
        assert np.allclose([r["mean"], r["low"], r["high"]], 1.0)
    with pytest.raises(ValueError):
        resolution.paired_interval(pairs, 20, 1, "other")


def test_draws_read_their_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    pairs = spark.createDataFrame([(i, float(i % 7)) for i in range(400)], "id long, diff double").mapInPandas(seen, "id long, diff double")
    got = resolution.multinomial_draws(pairs, 20, 9, bucket=4).collect()
    assert len(got) == 20 and all(r["items"] == 400 for r in got) and read.value == 400


def test_two_score_columns_are_paired_in_one_pass(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"l{j}", j, int(rng.random() < 0.3), float(rng.integers(0, 4)), float(rng.integers(0, 4))) for i in range(60) for j in range(6)]
    cells = spark.createDataFrame(rows, "id long, label string, ord int, y int, p double, q double")
    arm = lambda c: cells.select("id", "label", "ord", "y", F.col(c).alias("p"))
    two = resolution.paired_rows(arm("p"), arm("q"), 2)
    assert sorted(map(tuple, resolution.paired_columns(cells, "p", "q", 2).collect())) == sorted(map(tuple, two.collect()))
