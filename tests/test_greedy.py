"""Lazy greedy selection against the exhaustive rule in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.operators import design, greedy

from .test_selection import C, D, M, Twin, pool


def design_of(spark, seed=3):
    lab, lp, lf, _t, _y, fuser = pool(spark, 15, seed)
    ref, rp, rf, _t, ry, _ = pool(spark, 12, seed + 1, 100)
    return lab, ref, Twin(lf, lp, rf, rp, ry, 0.05), fuser


@pytest.mark.parametrize("seed,fold,parts", [(5, 3, 1), (6, 16, 4), (7, 1, 3)])
def test_gains_in_greedy_order(spark, seed, fold, parts):
    lab, ref, twin, _ = design_of(spark, seed)
    cand, cp, cf, _t, _y, _ = pool(spark, 120, seed + 7, 200)
    built = design.build(lab, ref, C, M * D, 0.05)
    out = greedy.by_gain(cand.repartition(parts), built, 15, fold)
    got = [(r["id"], r["score"]) for r in out.selection.orderBy("rank").collect()]
    want = []
    for _ in range(15):
        gain = twin.gain(cf, cp)
        gain[[i for i, _ in want]] = -1
        best = int(gain.argmax())
        want.append((best, gain[best]))
        twin.pick(cf[best], cp[best])
    assert [i for i, _ in got] == [200 + i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want])
    assert len(out.exact) == 15


def exhaustive(cells, size, twin, fuser, cf, cp, modalities, eta, budget):
    full, want, firsts = (1 << modalities) - 1, [], None
    feats = fuser.fuse(np.array([r["tokens"] for r in cells]))
    probs = fuser.probabilities(feats)
    for _ in range(budget):
        g = twin.gain(feats, probs)
        v, n = np.zeros((size, full + 1)), np.zeros((size, full + 1))
        for r, x in zip(cells, g):
            v[r["id"] - 200, r["coalition"]] += x
            n[r["id"] - 200, r["coalition"]] += 1
        v /= n
        v[:, 0] = v[:, 0].mean()
        add = sum(v[:, 1 << m] - v[:, 0] for m in range(modalities))
        higher = np.zeros(size)
        for c in range(full + 1):  # all interactions of two and more modalities, by definition
            if c.bit_count() >= 2:
                higher += sum((-1) ** (c.bit_count() - s.bit_count()) * v[:, s] for s in range(full + 1) if s & c == s)
        score = np.maximum(higher, 0) + eta * add
        firsts = score.copy() if firsts is None else firsts
        score[want] = -np.inf
        want.append(int(score.argmax()))
        twin.pick(cf[want[-1]], cp[want[-1]])
    return want, firsts


@pytest.mark.parametrize("seed,eta,parts", [(5, 0.25, 3), (9, 0.0, 2), (21, 1.0, 5)])
def test_whole_pool_equals_exhaustive_greedy(spark, seed, eta, parts):
    lab, ref, twin, fuser = design_of(spark, seed)
    cand, cp, cf, _t, _y, _ = pool(spark, 40, seed + 2, 200)
    out = design.acquire(lab, ref, cand.repartition(parts), fuser, C, M * D, M, 10, seed=11, partners=2, damping=0.05, eta=eta, fold_every=4)
    cells = design.counterfactual_tokens(cand, cand, M, 2, 11).collect()
    want, firsts = exhaustive(cells, 40, twin, fuser, cf, cp, M, eta, 10)
    assert [r["id"] for r in out.selection.orderBy("rank").collect()] == [200 + i for i in want]
    scores = out.scores.orderBy("id").collect()
    assert np.allclose([r["score"] for r in scores], firsts) and all(r["scored"] for r in scores)
    assert out.exact


def test_screened_rows_are_marked(spark):
    lab, ref, _twin, fuser = design_of(spark)
    cand = pool(spark, 30, 5, 200)[0]
    out = design.acquire(lab, ref, cand, fuser, C, M * D, M, 3, seed=11, workset=6, synergy_workset=4, partners=1, damping=0.05)
    rows = out.scores.collect()
    scored = [r["score"] for r in rows if r["scored"]]
    assert not out.exact and len(rows) == 30 and 6 <= len(scored) < 30
    assert all(r["score"] == min(scored) - 1 for r in rows if not r["scored"])
    picked = {r["id"] for r in out.selection.collect()}
    assert picked <= {r["id"] for r in rows if r["scored"]} and len(picked) == 3
    assert out.certificate.first()["union"] == len(scored)


def test_budget_beyond_the_pool_and_ties(spark):
    lab, ref, _twin, _ = design_of(spark)
    cand = pool(spark, 6, 5, 200)[0]
    twice = cand.unionByName(cand.withColumn("id", F.col("id") + 50))  # every item has an equal
    built = design.build(lab, ref, C, M * D, 0.05)
    got = [r["id"] for r in greedy.by_gain(twice.repartition(4), built, 40, 3).selection.orderBy("rank").collect()]
    assert len(got) == len(set(got)) == 12
    assert got.index(got[0]) == 0 and got[0] < 250  # the smaller id of the best pair comes first
    assert greedy.by_gain(twice.limit(0), built, 3).selection.collect() == []


def test_bounds_hold(spark):
    """The bounds of the stored alignment and coverage hold for the exact values after any steps."""
    lab, ref, _twin, _ = design_of(spark)
    cand, cp, cf, _t, _y, _ = pool(spark, 25, 8, 200)
    built = design.build(lab, ref, C, M * D, 0.05)
    state = design.Deflation.start(built)
    table = greedy.state_table(cand, cand.select("id", F.lit(0).alias("cell"), "features", "p"), built, greedy.Layout((greedy.FULL,)))
    b = greedy._Batch(table.toPandas(), 1, M * D)
    pending = greedy.Pending(C)
    for i in (3, 9, 14, 3):
        state.add(cf[i], cp[i])
        pending.add(np.append(cf[i], 1.0), *state.steps[-1], state.gradient)
        low, high = pending.bounds(b.w, b.a, b.q)
        a, q = pending.now(b.z, b.a, b.q)
        exact = (a**2 / (b.w + q)).sum(-1)
        assert (low <= exact + 1e-12).all() and (exact <= high + 1e-12).all()


def test_kernels_see_slices_of_a_batch(spark, monkeypatch):
    """No kernel of the selection gets more rows as Python objects at once than a slice has."""
    import pandas as pd

    from poolweave.functions import vectors

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f), None], "raw": [b"x", None], "v": [[1.0, 2.0], f["v"].iloc[0]]}).astype({"n": "Int64"})

    rows = spark.range(0, 5000, 1, 1).select("id", F.array(F.col("id").cast("double")).alias("v"))
    got = vectors.map_slices(rows, sizes, "n long, raw binary, v array<double>").collect()
    assert [r["n"] for r in got if r["raw"] is not None] == [1024] * 4 + [904] and got[1]["n"] is None and got[3]["v"] == [1024.0]
    assert vectors.map_slices(rows.filter("id < 0"), sizes, "n long, raw binary, v array<double>").count() == 0
    passes, whole = [], greedy.map_slices
    monkeypatch.setattr(greedy, "map_slices", lambda *a: passes.append(1) or whole(*a))
    lab, ref, _, _ = design_of(spark)
    cand = pool(spark, 60, 9, 200)[0]
    greedy.by_gain(cand, design.build(lab, ref, C, M * D, 0.05), 3, 2).selection.count()
    assert len(passes) >= 2 + 3  # the state is packed and covered, then one pass a pick
