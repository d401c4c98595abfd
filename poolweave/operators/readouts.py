"""Modality readouts: grouped out-of-fold logistic models and reliability weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import add_columns, sigmoid, stack, vector_sum
from ..session import cut_lineage
from . import disagreement
from .splits import balanced_folds


def positive_weights(labeled: DataFrame, maximum: float = 20.0) -> DataFrame:
    """(label, pos_weight): negatives over positives, clipped to [1, maximum]."""
    cells = labeled.select(F.posexplode("y").alias("label", "v"))
    pos = F.sum(F.col("v").cast("double"))
    ratio = (F.count("*") - pos) / F.greatest(pos, F.lit(1.0))
    return cells.groupBy("label").agg(
        F.greatest(F.least(ratio, F.lit(maximum)), F.lit(1.0)).alias("pos_weight")
    )


def with_folds(labeled: DataFrame, folds: int, key: str = "group_id") -> tuple[DataFrame, int]:
    """Attach a fold per whole group; fewer than two groups give no folds."""
    sizes = labeled.groupBy(key).agg(F.count("*").alias("_size"))
    groups = sizes.count()
    if groups < 2:
        return labeled.withColumn("fold", F.lit(-1)), 0
    count = min(max(2, folds), groups)
    fold = balanced_folds(sizes, key, "_size", count).select(key, "fold")
    return labeled.join(fold, key), count


def fit(
    labeled: DataFrame,
    folds: int,
    labels: int,
    modalities: int,
    width: int,
    epochs: int = 20,
    rate: float = 0.05,
    decay: float = 1e-4,
    maximum: float = 20.0,
) -> np.ndarray:
    """Weights [folds + 1, M, C, D + 1]; entry 0 is the full fit, entry f + 1 leaves out fold f.

    One job per epoch: each task returns the gradient sums of all models over its rows,
    and the driver takes the optimiser step. Rows stay where they are and are cached; a
    lost executor only recomputes its part. Labels are independent models, so when their
    weights outgrow the pass limit the labels are fitted in slices.
    """
    posw = disagreement.vector(positive_weights(labeled, maximum), "pos_weight", labels)
    data = labeled.select("tokens", "y", "fold").persist()
    per_pass = max(1, PASS_BYTES // (8 * (folds + 1) * modalities * (width + 1)))
    parts = []
    for start in range(0, labels, per_pass):
        mine = slice(start, min(start + per_pass, labels))
        shape = (folds + 1, modalities, mine.stop - mine.start, width + 1)
        parts.append(_fit_slice(data, posw[mine], mine, shape, labels, epochs, rate, decay))
    data.unpersist()
    return np.concatenate(parts, axis=2)


# Bytes of model weights (and of gradients) a task holds in one pass.
PASS_BYTES = 64 * 1024 * 1024


def _fit_slice(data, posw, mine, shape, labels, epochs, rate, decay) -> np.ndarray:
    """Full-batch adaptive-moment steps with decoupled decay for one slice of labels."""
    folds, modalities = shape[0] - 1, shape[1]
    context = data.sparkSession.sparkContext
    w, first, second = np.zeros(shape), np.zeros(shape), np.zeros(shape)

    def gradients(held):
        def run(batches):
            weights = held.value
            grad, rows = np.zeros(shape), np.zeros(folds + 1)
            for batch in batches:
                if not len(batch):
                    continue
                x = stack(batch["tokens"])
                x = np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)
                y = stack(batch["y"])[:, mine]
                fold = batch["fold"].to_numpy()
                for f in range(folds + 1):
                    use = slice(None) if f == 0 else fold != f - 1
                    xf, yf = x[use], y[use]
                    rows[f] += len(xf)
                    p = sigmoid(np.einsum("nmd,mcd->nmc", xf, weights[f]))
                    err = p * (1 + (posw - 1) * yf)[:, None, :] - (posw * yf)[:, None, :]
                    grad[f] += np.einsum("nmc,nmd->mcd", err, xf)
            yield pd.DataFrame({"f": range(folds + 1), "g": [g.ravel().tolist() for g in grad], "n": rows})

        return run

    for step in range(1, max(1, epochs) + 1):
        held = context.broadcast(w)
        sums = data.mapInPandas(gradients(held), "f int, g array<double>, n double")
        grad = np.zeros(shape)
        for r in sums.groupBy("f").agg(vector_sum("g").alias("g"), F.sum("n").alias("n")).collect():
            grad[r["f"]] = np.reshape(r["g"], shape[1:]) / (max(r["n"], 1.0) * modalities * labels)
        held.unpersist()
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w = w * (1 - rate * decay) - rate * move
    return w


def out_of_fold(labeled: DataFrame, weights: np.ndarray) -> DataFrame:
    """``q``: probabilities of each row from the model that did not see its fold."""

    def run(tokens, fold):
        own = weights[fold.astype(int) + 1]
        logits = np.einsum("nmd,nmcd->nmc", tokens, own[..., :-1]) + own[..., -1]
        return {"q": sigmoid(logits)}

    return add_columns(
        labeled.withColumn("_f", F.array("fold")), ["tokens", "_f"], "q array<array<double>>",
        lambda t, f: run(t, f[:, 0]),
    ).drop("_f")


def reliability(labeled: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """(modality, label) table: information gain over the prevalence loss, skill, standard
    error, shrunk skill and weights, from out-of-fold probabilities ``q`` and labels ``y``.

    Only two group aggregates touch the rows; everything after them is a table of
    modalities x labels.
    """
    eps = F.lit(epsilon)
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0 - epsilon)), eps)
    cells = labeled.select("y", F.posexplode("q").alias("modality", "_q")).select(
        "modality", F.posexplode(F.arrays_zip("y", "_q")).alias("label", "c")
    )
    y = F.col("c.y").cast("double")
    prev = (
        labeled.select(F.posexplode("y").alias("label", "v"))
        .groupBy("label")
        .agg(clip(F.avg(F.col("v").cast("double"))).alias("_r"), F.sum(F.col("v").cast("double")).alias("pos"))
    )
    joined = cells.join(F.broadcast(prev), "label")
    loss = lambda t: -(y * F.log(t) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - t))
    gain = loss(F.col("_r")) - loss(clip(F.col("c._q")))
    r = F.col("_r")
    entropy = F.greatest(-(r * F.log(r) + (F.lit(1.0) - r) * F.log(F.lit(1.0) - r)), eps)
    per = joined.groupBy("modality", "label").agg(
        F.avg(gain).alias("information_gain"),
        (F.coalesce(F.stddev_samp(gain), F.lit(0.0)) / F.sqrt(F.count("*").cast("double"))).alias("_se"),
        F.first("_r").alias("_r"),
        F.first("pos").alias("pos"),
    )
    per = per.withColumn("skill", F.col("information_gain") / entropy).withColumn(
        "skill_se", F.col("_se") / entropy
    )
    m = Window.partitionBy("modality")
    c = Window.partitionBy("label")
    total = F.greatest(F.sum("pos").over(m), F.lit(1.0))
    several = F.count("*").over(m) > 1
    per = per.withColumn("pooled_skill", F.sum(F.col("skill") * F.col("pos")).over(m) / total)
    observed = F.when(several, F.var_samp("skill").over(m)).otherwise(F.lit(0.0))
    sampling = F.avg(F.col("skill_se") * F.col("skill_se")).over(m)
    per = per.withColumn("_true", F.greatest(observed - sampling, F.lit(0.0)))
    post = F.col("_true") / F.greatest(F.col("_true") + F.col("skill_se") * F.col("skill_se"), eps)
    shrunk = F.when(F.col("_true") <= eps, F.col("pooled_skill")).otherwise(
        post * F.col("skill") + (F.lit(1.0) - post) * F.col("pooled_skill")
    )
    per = per.withColumn("shrunk_skill", shrunk).withColumn("_pos_skill", F.greatest("shrunk_skill", F.lit(0.0)))
    whole = F.sum("_pos_skill").over(c)
    even = F.lit(1.0) / F.count("*").over(c)
    per = per.withColumn("label_weight", F.when(whole > eps, F.col("_pos_skill") / whole).otherwise(even))
    pooled = F.sum(F.col("label_weight") * F.col("pos")).over(m) / total
    n_mod = F.count("*").over(c)
    return per.withColumn(
        "modality_weight",
        F.when(F.sum("pos").over(m) <= eps, F.lit(1.0) / n_mod).otherwise(pooled),
    ).select(
        "modality",
        "label",
        "information_gain",
        "skill",
        "skill_se",
        "pooled_skill",
        "shrunk_skill",
        "label_weight",
        "modality_weight",
    )


def train(
    labeled: DataFrame,
    labels: int,
    modalities: int,
    width: int,
    folds: int = 5,
    prototype: str = "mean",
    **options,
) -> disagreement.ReadoutState:
    """Full fit, grouped out-of-fold scores, reliability weights and prototypes."""
    rows, count = with_folds(labeled, folds)
    rows = cut_lineage(rows)
    weights = fit(rows, count, labels, modalities, width, **options)
    prevalence = disagreement.label_prevalence(rows)
    if count:
        scored = out_of_fold(rows, weights)
    else:
        flat = F.array(*[F.lit(float(v)) for v in disagreement.vector(prevalence, "prevalence", labels)])
        scored = rows.withColumn("q", F.array_repeat(flat, modalities))
    stats = reliability(scored)
    table = stats.select("modality", "label", "label_weight", "modality_weight")
    table = cut_lineage(table)
    protos = np.zeros((modalities, width))
    for r in disagreement.modality_prototypes(rows, prototype).collect():
        protos[r["modality"]] = r["vec"]
    from .prototypes import expected_cardinality

    state = disagreement.ReadoutState(
        weights=weights[0],
        label_weights=disagreement.matrix(table, "label_weight", modalities, labels),
        modality_weights=disagreement.matrix(table, "modality_weight", modalities, labels)[:, 0],
        prototypes=protos,
        prevalence=prevalence,
        cardinality=expected_cardinality(rows),
    )
    return state


@dataclass
class Fitted:
    """Weights as of ``fit``; passes over the rows; the largest gradient component of any model."""

    weights: np.ndarray
    passes: int
    gradient: float


def _values_and_gradients(data: DataFrame, w: np.ndarray, posw: np.ndarray, mine: slice, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean weighted loss plus decay / 2 |w|^2 of every model [folds + 1, M, C], and its gradient, in
    one pass: each task adds up its rows, and the sums are added in the JVM."""
    folds = w.shape[0] - 1
    held = data.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        weights = held.value
        grad, loss, rows = np.zeros(w.shape), np.zeros(w.shape[:-1]), np.zeros(folds + 1)
        for batch in batches:
            if not len(batch):
                continue
            x = stack(batch["tokens"])
            x = np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)
            y = stack(batch["y"])[:, None, mine]
            fold = batch["fold"].to_numpy()
            for f in range(folds + 1):
                use = slice(None) if f == 0 else fold != f - 1
                xf, yf = x[use], y[use]
                rows[f] += len(xf)
                z = np.einsum("nmd,mcd->nmc", xf, weights[f])
                # log(1 + exp(-z)) for positives, times their weight, and log(1 + exp(z)) for the others.
                loss[f] += (posw * yf * np.logaddexp(0, -z) + (1 - yf) * np.logaddexp(0, z)).sum(0)
                grad[f] += np.einsum("nmc,nmd->mcd", sigmoid(z) * (1 + (posw - 1) * yf) - posw * yf, xf)
        yield pd.DataFrame({"f": range(folds + 1), "g": [np.append(g.ravel(), v.ravel()).tolist() for g, v in zip(grad, loss)], "n": rows})

    sums = data.mapInPandas(run, "f int, g array<double>, n double").groupBy("f").agg(vector_sum("g").alias("g"), F.sum("n").alias("n"))
    grad, loss = np.zeros(w.shape), np.zeros(w.shape[:-1])
    for r in sums.collect():
        found = np.asarray(r["g"]) / max(r["n"], 1.0)
        grad[r["f"]], loss[r["f"]] = found[: grad[0].size].reshape(w.shape[1:]), found[grad[0].size :].reshape(w.shape[1:-1])
    held.unpersist()
    return loss + decay / 2 * (w**2).sum(-1), grad + decay * w


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse curvature that the pairs (step, change of gradient)
    stand for, for all models at once; a pair of zeros says nothing."""
    dot = lambda a, b: (a * b).sum(-1, keepdims=True)
    q, shares, scale = grad.copy(), [], None
    for s, y in pairs:  # the latest first
        sy = dot(s, y)
        known = sy > 0
        rho = np.where(known, 1 / np.where(known, sy, 1), 0.0)
        a = rho * dot(s, q)
        q -= a * y
        shares.append((rho, a))
        own = np.where(known, sy / np.where(known, dot(y, y), 1), np.nan)
        scale = own if scale is None else np.where(np.isnan(scale), own, scale)
    first = 1 / np.maximum(1.0, np.sqrt(dot(grad, grad)))
    q *= first if scale is None else np.where(np.isnan(scale), first, scale)
    for (s, y), (rho, a) in zip(reversed(pairs), reversed(shares)):
        q += s * (a - rho * dot(y, q))
    return -q


def fit_converged(
    labeled: DataFrame,
    folds: int,
    labels: int,
    modalities: int,
    width: int,
    decay: float = 1e-4,
    maximum: float = 20.0,
    tolerance: float = 1e-6,
    passes: int = 300,
    memory: int = 8,
) -> Fitted:
    """``fit`` to the optimum, by limited-memory BFGS: the models of all folds, modalities and labels
    at once, each with its own curvature pairs and line search.

    A pass over the rows gives value and gradient of every model at its trial point. Where the value
    fell enough the point is taken and a new direction follows; elsewhere the step is halved, and the
    next pass tries again. Models whose gradient is below ``tolerance`` rest. Labels that do not fit a
    task together are fitted in slices, as in ``fit``.
    """
    posw = disagreement.vector(positive_weights(labeled, maximum), "pos_weight", labels)
    data = labeled.select("tokens", "y", "fold").persist()
    per_pass = max(1, PASS_BYTES // (8 * (folds + 1) * modalities * (width + 1)))
    parts = [
        _minimised(data, posw[mine], mine, (folds + 1, modalities, mine.stop - mine.start, width + 1), decay, tolerance, passes, memory)
        for mine in (slice(a, min(a + per_pass, labels)) for a in range(0, labels, per_pass))
    ]
    data.unpersist()
    return Fitted(np.concatenate([p.weights for p in parts], axis=2), sum(p.passes for p in parts), max(p.gradient for p in parts))


def _minimised(data, posw, mine, shape, decay, tolerance, passes, memory) -> Fitted:
    w = np.zeros(shape)
    value, grad = _values_and_gradients(data, w, posw, mine, decay)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    direction, step, done = _direction(grad, pairs), np.ones(shape[:-1]), 1
    size = lambda g: np.abs(g).max(-1)
    while done < passes and (open_ := size(grad) > tolerance).any():
        trial = np.where(open_[..., None], w + step[..., None] * direction, w)
        now, slope = _values_and_gradients(data, trial, posw, mine, decay)
        done += 1
        # Rounding hides a fall that is smaller than a few units in the last place.
        fell = now <= value + 1e-4 * step * (grad * direction).sum(-1) + 4e-16 * np.abs(value)
        taken = open_ & (fell | (step < 1e-10))
        moved, bent = np.where(taken[..., None], trial - w, 0.0), np.where(taken[..., None], slope - grad, 0.0)
        w, grad, value = np.where(taken[..., None], trial, w), np.where(taken[..., None], slope, grad), np.where(taken, now, value)
        pairs = [(moved, bent), *pairs][:memory]
        fresh = _direction(grad, pairs)
        downhill = (fresh * grad).sum(-1) < 0
        fresh = np.where(downhill[..., None], fresh, -grad)
        direction, step = np.where(taken[..., None], fresh, direction), np.where(taken, 1.0, step / 2)
    return Fitted(w, done, float(size(grad).max(initial=0.0)))
