"""Acquisition formulas against hand cases and numpy twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.functions.vectors import SLICE_ROWS, LinearFuser, add_columns
from poolweave.operators import checks, design, disagreement as dg, mixup, prototypes as pt, readouts, selection
from poolweave.plans import methods

C, M, D = 3, 2, 4


def pool(spark, n, seed, start=0):
    rng = np.random.default_rng(seed)
    tokens = rng.normal(size=(n, M, D))
    fuser = LinearFuser(np.random.default_rng(99).normal(size=(C, M * D)), np.array([0.1, -0.2, 0.0]))
    feats = fuser.fuse(tokens)
    p = fuser.probabilities(feats)
    y = (rng.random((n, C)) < 0.4).astype(int)
    rows = [
        (start + i, (start + i) // 2, p[i].tolist(), feats[i].tolist(), tokens[i].tolist(), y[i].tolist()) for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "id long, group_id long, p array<double>, features array<double>, tokens array<array<double>>, y array<int>"
    )
    return df, p, feats, tokens, y, fuser


def test_prototype_score_hand_case(spark):
    rows = spark.createDataFrame(
        [(0, [0.9, 0.2], [0.8, -0.2]), (1, [0.6, 0.8], [0.0, 0.4]), (2, [0.2, 0.1], [-0.4, -0.5])],
        "id long, p array<double>, own array<double>",
    )
    out = pt.evidence_scores(rows, [0.1, 0.0], 1.0).orderBy("id").collect()
    evidence = [0.9, 0.5 + 0.7, 0.0]
    count = [1, 1, 0]
    for r, e, k in zip(out, evidence, count):
        want = np.sqrt(1 / (e + 2e-10)) * np.sqrt(abs(k - 1))
        assert r["combined"] == pytest.approx(want) and r["prototype_positive_count"] == k


def test_prototypes_keep_the_old_vector_of_an_empty_label(spark):
    rows = spark.createDataFrame([(0, [[3.0, 4.0]], [1, 0])], "id long, views array<array<double>>, y array<int>")
    old = spark.createDataFrame([(0, 1, [0.0, 1.0])], "view int, label int, vec array<double>")
    out = {r["label"]: (r["vec"], r["n"]) for r in pt.refresh_prototypes(rows, old).collect()}
    assert out[0] == ([0.6, 0.8], 1) and out[1] == ([0.0, 1.0], 0) and out[-1] == ([0.6, 0.8], 1)


def test_joined_similarity_equals_the_kernel(spark, monkeypatch):
    df = pt.stacked_views(pool(spark, 20, 1)[0], True)
    bank = pt.refresh_prototypes(df)
    a = pt.with_similarity(df, bank, C).orderBy("id").select("own", "background").collect()
    monkeypatch.setattr(pt, "BROADCAST_BYTES", 1)
    b = pt.with_similarity(df, bank, C).orderBy("id").select("own", "background").collect()
    for x, y in zip(a, b):
        assert np.allclose(x["own"], y["own"]) and np.allclose(x["background"], y["background"])


def decided(spark, q):
    rows = [(i, [0.5] * len(q[0][0]), v) for i, v in enumerate(q)]
    return spark.createDataFrame(rows, "id long, p array<double>, q array<array<double>>")


def test_disagreement_hand_cases(spark):
    df = decided(spark, [[[0.7, 0.3], [0.7, 0.3]], [[0.9, 0.1], [0.1, 0.9]]])
    out = dg.js_disagreement(dg.decisions(df, np.zeros(2), np.zeros((2, 2))), np.full((2, 2), 0.5)).orderBy("id").collect()
    assert out[0]["disagreement"] == pytest.approx(0, abs=1e-9) and out[1]["disagreement"] > 0.3


def test_support_falls_back_to_the_best_label(spark):
    df = decided(spark, [[[0.1, 0.2], [0.1, 0.2]]]).withColumn("p", F.array(F.lit(0.2), F.lit(0.4)))
    r = dg.decisions(df, np.ones(2), np.ones((2, 2))).first()
    assert r["support"] == [False, True] and r["fused_positive"] == [False, False]


def test_reliability_favours_the_informative_modality(spark):
    y, good = [1, 1, 0, 0], [0.9, 0.8, 0.1, 0.2]
    rows = [(i, [y[i]], [[good[i]], [0.5]]) for i in range(4)]
    out = readouts.reliability(spark.createDataFrame(rows, "id long, y array<int>, q array<array<double>>")).orderBy("modality").collect()
    assert out[0]["label_weight"] > out[1]["label_weight"]
    assert out[0]["label_weight"] + out[1]["label_weight"] == pytest.approx(1)


def instability_twin(tokens, base, protos, thr, fuser, grid, bisect):
    star = np.zeros(tokens.shape[:2])
    for i in range(len(tokens)):
        for m in range(tokens.shape[1]):
            def flip(a):
                t = tokens[i : i + 1].copy()
                t[0, m] = a * t[0, m] + (1 - a) * protos[m]
                return ((fuser.probabilities(fuser.fuse(t)) >= thr - dg.TIE)[0] != base[i]).any()

            hits = [1 - g / grid for g in range(1, grid + 1) if flip(1 - g / grid)]
            if hits:
                lo = max(hits)
                hi = min(lo + 1 / grid, 1.0)
                for _ in range(bisect):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if flip(mid) else (lo, mid)
                star[i, m] = lo
    return star


@pytest.mark.parametrize("bisect", [0, 4])
def test_critical_instability_twin(spark, bisect):
    df, p, _f, tokens, _y, fuser = pool(spark, 25, 2)
    thr = np.full(C, 0.5)
    base = p >= thr
    protos = tokens.mean(axis=0)
    work = df.withColumn("fused_positive", F.transform("p", lambda x: x >= 0.5))
    out = dg.critical_instability(work, fuser, protos, thr, np.array([0.5, 0.5]), 6, bisect).orderBy("id").collect()
    want = instability_twin(tokens, base, protos, thr, fuser, 6, bisect)
    assert np.allclose([r["alpha"] for r in out], want)
    assert np.allclose([r["instability"] for r in out], want.mean(axis=1))


def test_lattice_hand_case(spark):
    rows = spark.createDataFrame([(0, c, v) for c, v in enumerate([1.0, 3.0, 4.0, 10.0])], "id long, coalition int, gain double")
    r = design.lattice_scores(design.lattice_values(rows, 2), 2, 0.25).first()
    assert [r[f"i{c}"] for c in range(4)] == [1, 2, 3, 4]
    assert (r["additive"], r["synergy"], r["score"]) == (5, 4, 5.25)


class Twin:
    """Direct numpy form of the design."""

    def __init__(self, feats, p, rfeats, rp, ry, damping):
        z = np.c_[feats, np.ones(len(feats))]
        w = p * (1 - p)
        self.a = np.einsum("nc,nd,ne->cde", w, z, z) + damping * np.eye(z.shape[1])
        rz = np.c_[rfeats, np.ones(len(rfeats))]
        self.g = np.einsum("nc,nd->cd", rp - ry, rz) / len(rz)

    def gain(self, feats, p):
        z = np.c_[feats, np.ones(len(feats))]
        inv = np.linalg.inv(self.a)
        d = np.einsum("cde,ce->cd", inv, self.g)
        cov = np.einsum("nd,cde,ne->nc", z, inv, z)
        return ((z @ d.T) ** 2 / (1 / (p * (1 - p)) + cov)).sum(1)

    def bound(self, feats, p):
        z = np.c_[feats, np.ones(len(feats))]
        d = np.einsum("cde,ce->cd", np.linalg.inv(self.a), self.g)
        trace = np.trace(self.a, axis1=1, axis2=2)
        return ((z @ d.T) ** 2 / (1 / (p * (1 - p)) + (z**2).sum(1)[:, None] / trace)).sum(1)

    def pick(self, f, p):
        z = np.append(f, 1.0)
        self.a = self.a + (p * (1 - p))[:, None, None] * np.outer(z, z)[None]


def ordered(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_design_twin_and_deflation(spark, monkeypatch):
    lab, lp, lf, _t, _y, _ = pool(spark, 15, 3)
    ref, rp, rf, _t, ry, _ = pool(spark, 12, 4, 100)
    cand, cp, cf, _t, _y, _ = pool(spark, 30, 5, 200)
    built = design.build(lab, ref, C, M * D, 0.05)
    twin = Twin(lf, lp, rf, rp, ry, 0.05)
    assert np.allclose(ordered(design.upper_bound(cand, built), "bound"), twin.bound(cf, cp))
    gain = ordered(design.marginal_gain(cand, built), "gain")
    assert np.allclose(gain, twin.gain(cf, cp)) and (ordered(design.upper_bound(cand, built), "bound") >= gain - 1e-12).all()
    # One label per slice must give the same gains as all labels at once.
    monkeypatch.setattr(design.FisherDesign, "slices", lambda self, limit=0: [range(i, i + 1) for i in range(self.labels)])
    assert np.allclose(ordered(design.marginal_gain(cand, built), "gain"), gain)
    covered = design.coverage(cand.select("id", "features", "p"), ["id"], built)
    state = design.Deflation.start(built)
    for k in (3, 7, 11):
        state.add(cf[k], cp[k])
        twin.pick(cf[k], cp[k])
        if k == 7:
            covered = design.fold_coverage(covered, state.steps)
            state.fold()
    assert np.allclose(ordered(design.gains(covered, ["id"], state.direction, state.steps), "gain"), twin.gain(cf, cp))
    assert np.allclose(state.trace, np.trace(twin.a, axis1=1, axis2=2))


def test_greedy_selection_twin(spark):
    lab, lp, lf, _t, _y, fuser = pool(spark, 15, 3)
    ref, rp, rf, _t, ry, _ = pool(spark, 12, 4, 100)
    cand, cp, cf, ct, _y, _ = pool(spark, 18, 5, 200)
    out = design.acquire(
        lab, ref, cand, fuser, C, M * D, M, 6, seed=11, workset=18, synergy_workset=18, partners=2, damping=0.05, deflation_steps=4, fold_every=2
    )
    picked = [r["id"] for r in out.selection.orderBy("rank").collect()]
    cells = design.counterfactual_tokens(cand, cand, M, 2, 11).collect()
    twin = Twin(lf, lp, rf, rp, ry, 0.05)
    want = []
    for step in range(6):
        if step < 4:
            toks = np.array([r["tokens"] for r in cells])
            feats = fuser.fuse(toks)
            g = twin.gain(feats, fuser.probabilities(feats))
            v = np.zeros((18, 4))
            n = np.zeros((18, 4))
            for r, x in zip(cells, g):
                v[r["id"] - 200, r["coalition"]] += x
                n[r["id"] - 200, r["coalition"]] += 1
            v = v / n
            v[:, 0] = v[:, 0].mean()
            syn = v[:, 3] - v[:, 1] - v[:, 2] + v[:, 0]
            score = np.maximum(syn, 0) + 0.25 * (v[:, 1] + v[:, 2] - 2 * v[:, 0])
        order = [i for i in np.lexsort((np.arange(18), -score)) if i not in want]
        want.append(order[0])
        if step < 3:
            twin.pick(cf[order[0]], cp[order[0]])
    assert picked == [200 + i for i in want]


def test_readout_fit_separates_and_leaves_folds_out(spark):
    rng = np.random.default_rng(8)
    y = (rng.random((80, 1)) < 0.5).astype(int)
    tokens = np.stack([np.c_[(2 * y - 1) * 2 + rng.normal(size=(80, 1)) * 0.3], rng.normal(size=(80, 1))], axis=1)
    rows = [(i, i // 2, tokens[i].tolist(), y[i].tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, group_id long, tokens array<array<double>>, y array<int>")
    folded, n = readouts.with_folds(df, 4)
    assert n == 4 and folded.groupBy("group_id").agg(F.countDistinct("fold").alias("k")).filter("k > 1").isEmpty()
    w = readouts.fit(folded, n, 1, 2, 1, epochs=30, rate=0.2)
    q = np.array([r["q"] for r in readouts.out_of_fold(folded, w).orderBy("id").collect()])
    assert ((q[:, 0, 0] > 0.5) == (y[:, 0] == 1)).mean() > 0.95
    stats = readouts.reliability(readouts.out_of_fold(folded, w)).orderBy("modality").collect()
    assert stats[0]["modality_weight"] > 0.9


def test_single_group_gives_prevalence_readouts(spark):
    df = pool(spark, 6, 9)[0].withColumn("group_id", F.lit(1).cast("long"))
    state = readouts.train(df, C, M, D, folds=3, epochs=2)
    assert np.allclose(state.label_weights, 0.5)


def test_beta_quantiles():
    rng = np.random.default_rng(0)
    for alpha in (0.2, 0.4, 1.0, 3.0):
        x = mixup.beta_quantile(np.linspace(0.0005, 0.9995, 4000), alpha)
        draws = rng.beta(alpha, alpha, 400_000)
        assert abs(x.mean() - 0.5) < 1e-3
        for q in (0.1, 0.3, 0.5, 0.8):
            assert abs(np.quantile(x, q) - np.quantile(draws, q)) < 0.01


def test_mixup_invariants(spark):
    df, _p, _f, _t, y, _ = pool(spark, 60, 10)
    rule = mixup.Mixing()
    a = mixup.plan(df, rule, 3)
    b = mixup.plan(df.repartition(9), rule, 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    rows = a.collect()
    assert all(r["lam"] >= 0.5 and r["anchor_id"] != r["partner_id"] for r in rows)
    cut = np.quantile(y.sum(1), 0.5)
    assert all(y[r["anchor_id"]].sum() <= cut for r in rows)
    for r in mixup.virtual_rows(df, a, ["features"]).collect():
        assert all(0 <= v <= 1 for v in r["y"])
    with pytest.raises(ValueError):
        mixup.Mixing(shape=0).checked()


def test_group_aggregation_hand_case(spark):
    tok = {"a": ("p2", [[2, 0], [0, 2]]), "b": ("p1", [[1, 0], [0, 1]]), "c": ("p1", [[3, 0], [0, 3]]), "d": ("p2", [[4, 0], [0, 4]]), "e": ("p3", [[5, 1], [1, 5]])}
    y = {"a": [1, 0], "b": [1, 0], "c": [0, 1], "d": [0, 1], "e": [1, 1]}
    rows = [(g, [[float(v) for v in r] for r in t], y[k]) for k, (g, t) in tok.items()]
    df = spark.createDataFrame(rows, "group_id string, tokens array<array<double>>, y array<int>")
    out = {r["group_id"]: r for r in selection.group_outputs(df).collect()}
    assert [out[g]["items"] for g in ("p1", "p2", "p3")] == [2, 2, 1]
    assert out["p1"]["tokens"] == [[2, 0], [0, 2]] and out["p2"]["tokens"] == [[3, 0], [0, 3]] and out["p3"]["tokens"] == [[5, 1], [1, 5]]
    assert all(out[g]["y"] == [1, 1] for g in out)


@pytest.mark.parametrize("name", list(methods.METHODS))
def test_every_method_returns_the_exact_budget(spark, name):
    lab, *_r, fuser = pool(spark, 12, 21)
    cand = pool(spark, 14, 22, 100)[0]
    ref = pool(spark, 8, 23, 200)[0]
    options = {
        "disagreement": {"folds": 2, "epochs": 2, "workset": 10},
        "fused_disagreement": {"folds": 2, "epochs": 2, "workset": 10},
        "design_synergy": {"workset": 10, "synergy_workset": 5, "partners": 2, "deflation_steps": 2},
    }.get(name, {})
    c = methods.Context(
        cand, lab, 5, seed=1, reference=ref, fuser=fuser, labels=C, modalities=M, width=D, feature_width=M * D, options=options
    )
    ids = [r["id"] for r in methods.acquire(name, c).collect()]
    assert len(ids) == len(set(ids)) == 5 and all(100 <= i < 114 for i in ids)


def test_missing_inputs_are_refused(spark):
    df = pool(spark, 5, 1)[0]
    with pytest.raises(checks.AuditError, match="needs a fuser"):
        methods.require("disagreement", methods.Context(df, df, 2))
    with pytest.raises(checks.AuditError, match="missing columns"):
        methods.require("prototype", methods.Context(df.drop("p"), df, 2))
    with pytest.raises(checks.AuditError, match="unknown method"):
        methods.require("nope", methods.Context(df, df, 2))


def test_readout_slices_equal_one_pass(spark, monkeypatch):
    folded, n = readouts.with_folds(pool(spark, 20, 30)[0], 2)
    whole = readouts.fit(folded, n, C, M, D, epochs=3)
    monkeypatch.setattr(readouts, "PASS_BYTES", 1)
    assert np.allclose(readouts.fit(folded, n, C, M, D, epochs=3), whole)


def test_counterfactual_partners_do_not_depend_on_the_join(spark):
    df = pool(spark, 15, 31)[0]
    a = design.counterfactual_tokens(df, df, M, 2, 5)
    b = design.counterfactual_tokens(df.repartition(6), df.repartition(3), M, 2, 5, bounded_work=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_pass_works_on_slices_of_a_batch(spark):
    rows = spark.range(5000, numPartitions=1).select("id", F.array(F.array("id", -F.col("id"))).alias("v"))
    out = add_columns(rows, ["v"], "seen long, twice array<array<double>>", lambda v: {"seen": np.full(len(v), len(v)), "twice": 2 * v})
    got = out.orderBy("id").collect()
    assert max(r["seen"] for r in got) <= SLICE_ROWS
    assert [r["twice"] for r in got] == [[[2.0 * i, -2.0 * i]] for i in range(5000)]


def test_measures_are_one_python_pass(spark):
    df = pool(spark, 40, 3)[0].select("id", "p", F.col("tokens").alias("_t")).withColumn("q", F.array("p", F.transform("p", lambda x: 1 - x))).drop("_t")
    fused, probe, weights = np.full(C, 0.5), np.full((M, C), 0.4), np.full((M, C), 0.5)
    one = dg.measures(df, fused, probe, weights)
    three = dg.sufficiency(dg.js_disagreement(dg.decisions(df, fused, probe), weights))
    assert one.orderBy("id").collect() == three.orderBy("id").collect()
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
