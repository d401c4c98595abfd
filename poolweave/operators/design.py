"""Fisher design per label, modality lattice and greedy design-and-synergy selection.

Design blocks stay a distributed table with one row per label. Rows are scored in Arrow
batches against slices of that table that fit the closure limit, so neither the number of
labels nor the feature width is bounded by one task. The greedy loop never rewrites the
blocks: a pick is a rank-one term, kept as two small arrays per label, and the terms are
folded into the stored tables every few picks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..functions.columns import cosine, uniform
from ..functions.ranks import row_ranks, take_top
from ..functions.vectors import BROADCAST_BYTES, map_slices, stack, vector_sum
from ..session import cut_lineage
from . import selection
from .mixup import beta_draw

# Damping factors tried in turn until every block is positive definite.
DAMPING_SCALES = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)


@dataclass
class FisherDesign:
    """(label, inverse, gradient, direction, trace) rows and the damping in use."""

    blocks: DataFrame
    labels: int
    width: int
    damping: float

    def slices(self, limit: int = BROADCAST_BYTES) -> list[range]:
        size = max(1, limit // (8 * (self.width + 1) ** 2))
        return [range(i, min(i + size, self.labels)) for i in range(0, self.labels, size)]


def _bias(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _information(labeled: DataFrame, labels: int, width: int) -> DataFrame:
    """(label, i, row): rows of the weighted outer-product sums, added up in the JVM."""
    d = width + 1
    per_pass = max(1, BROADCAST_BYTES // (8 * d * d))
    parts = []
    for start in range(0, labels, per_pass):
        mine = range(start, min(start + per_pass, labels))

        def kernel(batches, mine=mine):
            gram = np.zeros((len(mine), d, d))
            for batch in batches:
                if not len(batch):
                    continue
                z = _bias(stack(batch["features"]))
                p = stack(batch["p"])[:, mine.start : mine.stop]
                for j, s in enumerate((p * (1 - p)).T):
                    gram[j] += (z * s[:, None]).T @ z
            yield pd.DataFrame(
                {
                    "label": np.repeat(list(mine), d),
                    "i": np.tile(np.arange(d), len(mine)),
                    "row": gram.reshape(-1, d).tolist(),
                }
            )

        parts.append(map_slices(labeled.select("features", "p"), kernel, "label int, i int, row array<double>"))
    from .checks import union_all

    return union_all(parts).groupBy("label", "i").agg(vector_sum("row").alias("row"))


def _gradients(reference: DataFrame, labels: int, width: int) -> DataFrame:
    """(label, gradient): mean over reference rows of (p - y) times the feature."""

    def kernel(batches):
        total, rows = np.zeros((labels, width + 1)), 0
        for batch in batches:
            if len(batch):
                z = _bias(stack(batch["features"]))
                total += (stack(batch["p"]) - stack(batch["y"])).T @ z
                rows += len(batch)
        yield pd.DataFrame({"label": range(labels), "g": total.tolist(), "n": rows})

    parts = map_slices(reference.select("features", "p", "y"), kernel, "label int, g array<double>, n long")
    summed = parts.groupBy("label").agg(vector_sum("g").alias("g"), F.sum("n").alias("n"))
    return summed.select("label", F.transform("g", lambda x: x / F.greatest("n", F.lit(1))).alias("gradient"))


def build(
    labeled: DataFrame,
    reference: DataFrame,
    labels: int,
    width: int,
    damping: float,
    closure: DataFrame | None = None,
) -> FisherDesign:
    """Inverse information, reference gradient and direction of every label."""
    if damping <= 0:
        raise ValueError("damping must be positive")
    rows = labeled.select("features", "p")
    if closure is not None:
        rows = rows.unionByName(closure.select("features", "p"))
    info = cut_lineage(_information(rows, labels, width))
    grads = _gradients(reference, labels, width)
    d = width + 1

    def invert(used: float):
        # One label's block: d rows of d numbers, the size of the design itself.
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            a = np.stack(pdf.sort_values("i")["row"].to_list()) + used * np.eye(d)
            try:
                np.linalg.cholesky(a)
                inverse, good = np.linalg.inv(a), True
            except np.linalg.LinAlgError:
                inverse, good = np.zeros((d, d)), False
            return pd.DataFrame(
                {"label": [pdf["label"].iloc[0]], "inverse": [inverse.ravel().tolist()], "trace": [np.trace(a)], "good": [good]}
            )

        return one

    schema = "label int, inverse array<double>, trace double, good boolean"
    for scale in DAMPING_SCALES:
        used = damping * scale
        solved = cut_lineage(info.groupBy("label").applyInPandas(invert(used), schema))
        if solved.filter(~F.col("good")).isEmpty():
            break
    else:
        raise RuntimeError("design blocks are not positive definite; increase the damping")

    def direct(batches):
        for batch in batches:
            if len(batch):
                inv = stack(batch["inverse"]).reshape(-1, d, d)
                yield batch.assign(direction=np.einsum("cde,ce->cd", inv, stack(batch["gradient"])).tolist())

    joined = solved.drop("good").join(grads, "label")
    fields = "label int, inverse array<double>, trace double, gradient array<double>, direction array<double>"
    blocks = cut_lineage(joined.mapInPandas(direct, fields))
    return FisherDesign(blocks, labels, width, used)


def _per_label(design: FisherDesign, *columns: str) -> dict[str, np.ndarray]:
    """Arrays over labels of the small design columns (directions, gradients, traces)."""
    rows = {r["label"]: r for r in design.blocks.select("label", *columns).collect()}
    return {c: np.array([rows[i][c] for i in range(design.labels)]) for c in columns}


def upper_bound(rows: DataFrame, design: FisherDesign) -> DataFrame:
    """(id, bound): cheap upper bound of the gain for the whole pool."""
    small = _per_label(design, "direction", "trace")
    direction, trace = small["direction"], small["trace"]

    def kernel(batches):
        for batch in batches:
            if len(batch):
                z, p = _bias(stack(batch["features"])), stack(batch["p"])
                v = np.maximum(p * (1 - p), 1e-8)
                align = z @ direction.T
                bound = (align**2 / (1 / v + (z**2).sum(1, keepdims=True) / trace[None])).sum(1)
                yield pd.DataFrame({"id": batch["id"], "bound": bound})

    return map_slices(rows.select("id", "features", "p"), kernel, "id long, bound double")


def coverage(rows: DataFrame, keys: list[str], design: FisherDesign) -> DataFrame:
    """rows + ``cov``: z' A^-1 z per label, one pass per slice of labels.

    Rows stay where they are: every pass appends its labels to ``cov``. Between passes the rows are
    stored and the slice that is done with is freed, so one slice is in memory at a time.
    """
    d = design.width + 1
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["cov array<double>"])
    slices = list(design.slices())
    for number, mine in enumerate(slices):
        block = design.blocks.filter(F.col("label").between(mine.start, mine.stop - 1)).select("label", "inverse")
        inverse = np.stack(
            [np.asarray(r["inverse"]).reshape(d, d) for r in sorted(block.collect(), key=lambda r: r["label"])]
        )
        held = rows.sparkSession.sparkContext.broadcast(inverse)

        def kernel(batches, held=held, first=number == 0):
            for batch in batches:
                if len(batch):
                    z = _bias(stack(batch["features"]))
                    cov = np.stack([((z @ a) * z).sum(1) for a in held.value], axis=1)
                    yield batch.assign(cov=list(cov if first else np.concatenate([stack(batch["cov"]), cov], axis=1)))

        rows = rows.mapInPandas(kernel, schema)
        if number + 1 < len(slices):
            rows = cut_lineage(rows)
            held.destroy()
    return rows


def _gain(z, p, cov, direction, steps) -> np.ndarray:
    v = p * (1 - p)
    for u, coef in steps:
        cov = cov - coef[None] * (z @ u.T) ** 2
    return ((z @ direction.T) ** 2 / (1 / np.maximum(v, 1e-8) + cov)).sum(1)


def gains(covered: DataFrame, keys: list[str], direction: np.ndarray, steps: list) -> DataFrame:
    """Exact marginal gain of rows with known coverage after the given rank-one steps."""
    types = {f.name: f.dataType.simpleString() for f in covered.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["gain double"])

    def kernel(batches):
        for batch in batches:
            if len(batch):
                z = _bias(stack(batch["features"]))
                gain = _gain(z, stack(batch["p"]), stack(batch["cov"]), direction, steps)
                yield batch[keys].assign(gain=gain)

    return covered.select(*keys, "features", "p", "cov").mapInPandas(kernel, schema)


def marginal_gain(rows: DataFrame, design: FisherDesign, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["id"]
    direction = _per_label(design, "direction")["direction"]
    return gains(coverage(rows.select(*keys, "features", "p"), keys, design), keys, direction, [])


@dataclass
class Deflation:
    """Rank-one updates since the blocks were last written: small arrays per label."""

    design: FisherDesign
    gradient: np.ndarray
    direction: np.ndarray
    trace: np.ndarray
    steps: list = field(default_factory=list)

    @classmethod
    def start(cls, design: FisherDesign) -> Deflation:
        s = _per_label(design, "gradient", "direction", "trace")
        return cls(design, s["gradient"], s["direction"].copy(), s["trace"].copy())

    def add(self, feature: np.ndarray, p: np.ndarray) -> None:
        """Fold in one pick; only A^-1 z is asked from the stored blocks."""
        z = np.append(np.asarray(feature, dtype=float), 1.0)
        v = np.asarray(p, dtype=float) * (1 - np.asarray(p, dtype=float))
        d = self.design.width + 1

        def kernel(batches):
            for batch in batches:
                if len(batch):
                    inv = stack(batch["inverse"]).reshape(-1, d, d)
                    yield pd.DataFrame({"label": batch["label"], "u": (inv @ z).tolist()})

        rows = self.design.blocks.select("label", "inverse").mapInPandas(kernel, "label int, u array<double>").collect()
        u = np.stack([np.asarray(r["u"]) for r in sorted(rows, key=lambda r: r["label"])])
        for prev, coef in self.steps:
            u = u - coef[:, None] * prev * (prev @ z)[:, None]
        coef = v / (1.0 + v * (u @ z))
        self.steps.append((u, coef))
        self.direction = self.direction - coef[:, None] * u * np.einsum("cd,cd->c", u, self.gradient)[:, None]
        self.trace = self.trace + v * (z @ z)

    def fold(self) -> None:
        """Write the pending steps into the blocks and start an empty list."""
        d, steps, direction, trace = self.design.width + 1, self.steps, self.direction, self.trace

        def kernel(batches):
            for batch in batches:
                if len(batch):
                    inv = stack(batch["inverse"]).reshape(-1, d, d).copy()
                    at = batch["label"].to_numpy()
                    for u, coef in steps:
                        inv -= coef[at][:, None, None] * u[at][:, :, None] * u[at][:, None, :]
                    yield batch.assign(
                        inverse=inv.reshape(len(batch), -1).tolist(), direction=direction[at].tolist(), trace=trace[at]
                    )

        blocks = self.design.blocks
        self.design = FisherDesign(
            cut_lineage(blocks.mapInPandas(kernel, blocks.schema)), self.design.labels, self.design.width, self.design.damping
        )
        self.steps = []


def fold_coverage(covered: DataFrame, steps: list) -> DataFrame:
    """Write the pending steps into the stored coverage."""

    def kernel(batches):
        for batch in batches:
            if len(batch):
                z, cov = _bias(stack(batch["features"])), stack(batch["cov"])
                for u, coef in steps:
                    cov = cov - coef[None] * (z @ u.T) ** 2
                yield batch.assign(cov=cov.tolist())

    return cut_lineage(covered.mapInPandas(kernel, covered.schema))


def pairwise_similarity(rows: DataFrame, modalities: int) -> DataFrame:
    """Mean cosine between an item's modality tokens: an expression over literal pairs."""
    if modalities < 2:
        raise ValueError("at least two modality tokens are needed")
    pairs = [(a, b) for a in range(modalities) for b in range(a + 1, modalities)]
    total = sum(
        (cosine(F.element_at("tokens", a + 1), F.element_at("tokens", b + 1)) for a, b in pairs), F.lit(0.0)
    )
    return rows.withColumn("similarity", total / F.lit(float(len(pairs))))


def rank_union(scored: DataFrame, bound: str, proxy: str, design_size: int, synergy_size: int) -> DataFrame:
    """Union of the two top branches with a flag per branch."""
    a = take_top(scored, bound, "id", max(design_size, 1)).select("id", F.lit(True).alias("_d"))
    b = take_top(scored, proxy, "id", max(synergy_size, 1)).select("id", F.lit(True).alias("_s"))
    return a.join(b, "id", "full_outer").select(
        "id",
        F.coalesce("_d", F.lit(False)).alias("design_branch"),
        F.coalesce("_s", F.lit(False)).alias("synergy_branch"),
    )


def union_certificate(union: DataFrame) -> DataFrame:
    return union.agg(
        F.count_if("design_branch").alias("design_branch"),
        F.count_if("synergy_branch").alias("synergy_branch"),
        F.count_if(F.col("design_branch") & F.col("synergy_branch")).alias("intersection"),
        F.count("*").alias("union"),
    )


def counterfactual_tokens(
    work: DataFrame,
    pool: DataFrame,
    modalities: int,
    partners: int,
    seed: int,
    masks: list[int] | None = None,
    lambda_alpha: float | None = None,
    salt: str = "partner",
    bounded_work: bool = False,
) -> DataFrame:
    """(id, coalition, partner_no, tokens): keep a coalition's modalities and take the
    others from hash-drawn partners of the pool, optionally as a Beta mix.

    Partners are drawn as positions in the pool. Only ids are ranked; the drawn positions
    become ids, and those ids fetch their tokens, so the pool's vectors are read once and
    never copied. ``bounded_work`` says the work set is small enough (a screened set) for
    the drawn ids to be broadcast against the pool. Kept modalities enter no join.
    """
    masks = list(range(1 << modalities)) if masks is None else masks
    indexed = row_ranks(pool.select("id"), [], "id", "id", "_pos").withColumnRenamed("id", "_other")
    count = pool.agg(F.count("*").alias("_n"))
    grid = work.select("id", F.col("tokens").alias("_own"))
    grid = grid.withColumn("coalition", F.explode(F.array(*[F.lit(m) for m in masks])))
    grid = grid.withColumn("partner_no", F.explode(F.sequence(F.lit(0), F.lit(max(1, partners) - 1))))
    cells = grid.select("id", "coalition", "partner_no", F.posexplode("_own").alias("modality", "own"))
    keep = F.expr("(shiftright(coalition, modality) & 1) = 1")
    kept = cells.filter(keep).withColumn("vec", F.transform("own", lambda x: x.cast("double"))).drop("own")
    u = uniform(seed, salt, F.col("id"), F.col("coalition"), F.col("partner_no"), F.col("modality"))
    drawn = with_scalars(cells.filter(~keep), count).withColumn(
        "_pos", (F.least(F.floor(u * F.col("_n")), F.col("_n") - 1) + 1).cast("bigint")
    )
    drawn = drawn.join(indexed, "_pos")
    wanted = drawn.select("_other").distinct()
    source = pool.select(F.col("id").alias("_other"), "tokens").join(
        F.broadcast(wanted) if bounded_work else wanted, "_other", "left_semi"
    )
    source = source.select("_other", F.posexplode("tokens").alias("modality", "other"))
    swapped = drawn.join(source, ["_other", "modality"])
    other = F.transform("other", lambda x: x.cast("double"))
    if lambda_alpha and lambda_alpha > 0:
        w = uniform(seed, f"{salt}-mix", F.col("id"), F.col("coalition"), F.col("partner_no"), F.col("modality"))
        swapped = swapped.withColumn("_lam", beta_draw(w, lambda_alpha))
        other = F.zip_with("own", "other", lambda a, b: (F.lit(1.0) - F.col("_lam")) * a + F.col("_lam") * b)
    swapped = swapped.select("id", "coalition", "partner_no", "modality", other.alias("vec"))
    # M tokens per key, one per modality.
    return (
        kept.unionByName(swapped)
        .groupBy("id", "coalition", "partner_no")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("modality", "vec"))), lambda t: t["vec"]).alias("tokens")
        )
    )


def closure_samples(labeled: DataFrame, modalities: int, count: int, seed: int, fuser, lambda_alpha=None) -> DataFrame:
    """Fused chimeras of labeled rows: every modality from its own hash-drawn row."""
    indexed = row_ranks(labeled.select("id"), [], "id", "id", "_pos")
    size = labeled.agg(F.count("*").alias("_n"))
    draws = with_scalars(labeled.sparkSession.range(count).withColumnRenamed("id", "sample"), size)
    base = draws.select(
        "sample", (F.floor(uniform(seed, "closure", "sample") * F.col("_n")) + 1).cast("bigint").alias("_pos")
    ).join(indexed, "_pos").join(labeled.select("id", "tokens"), "id")
    work = base.select(F.col("sample").alias("id"), "tokens")
    mixed = counterfactual_tokens(work, labeled, modalities, 1, seed, [0], lambda_alpha, "closure-partner")
    return selection.with_fused(mixed.select("id", "tokens"), fuser).select("id", "features", "p")


def lattice_values(cell_gains: DataFrame, modalities: int) -> DataFrame:
    """(id, v0 .. v[2^M - 1]): mean gain per coalition; the empty one is the pool mean."""
    size = 1 << modalities
    wide = cell_gains.groupBy("id").agg(
        *[F.avg(F.when(F.col("coalition") == c, F.col("gain"))).alias(f"v{c}") for c in range(size)]
    )
    base = wide.agg(F.avg("v0").alias("_v0"))
    return with_scalars(wide, base).withColumn("v0", F.col("_v0")).drop("_v0")


def interactions(values: DataFrame, modalities: int) -> DataFrame:
    """Moebius inversion over subsets: columns i0 .. i[2^M - 1].

    In place, one pass over the 2^M values for each modality: what holds the modality loses what does
    not. NULL where a value that counts is NULL.
    """
    size = 1 << modalities
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields] + [f"i{c} double" for c in range(size)])

    def kernel(batches):
        for batch in batches:
            x = batch[[f"v{c}" for c in range(size)]].to_numpy(np.float64, copy=True).reshape(len(batch), *[2] * modalities)
            for axis in range(1, modalities + 1):
                half = np.moveaxis(x, axis, 0)
                half[1] -= half[0]
            found = pd.DataFrame(x.reshape(len(batch), size), columns=[f"i{c}" for c in range(size)], index=batch.index)
            yield pd.concat([batch, found.astype(object).where(found.notna(), None)], axis=1)

    return values.mapInPandas(kernel, schema)


def lattice_scores(values: DataFrame, modalities: int, eta: float) -> DataFrame:
    """additive, synergy and max(synergy, 0) + eta * additive."""
    out = interactions(values, modalities)
    single = sum((F.col(f"i{1 << m}") for m in range(modalities)), F.lit(0.0))
    higher = sum((F.col(f"i{c}") for c in range(1 << modalities) if c.bit_count() >= 2), F.lit(0.0))
    out = out.withColumn("additive", single).withColumn("synergy", higher)
    return out.withColumn(
        "score", F.greatest("synergy", F.lit(0.0)) + F.lit(float(eta)) * F.col("additive")
    )


@dataclass
class DesignAcquired:
    """Picks; initial scores of all candidates, those outside the work set marked and one below the
    least; the overlap of the two screens; whether the work set is the whole pool."""

    selection: DataFrame
    scores: DataFrame
    certificate: DataFrame
    damping: float
    exact: bool
    worked_out: list[int]


def acquire(
    labeled: DataFrame,
    reference: DataFrame,
    candidates: DataFrame,
    fuser,
    labels: int,
    width: int,
    modalities: int,
    budget: int,
    seed: int,
    workset: int | None = None,
    synergy_workset: int | None = None,
    partners: int = 4,
    eta: float = 0.25,
    damping: float = 0.01,
    deflation_steps: int | None = None,
    closure: int = 0,
    lambda_alpha: float | None = None,
    fold_every: int = 16,
) -> DesignAcquired:
    """Design-and-synergy selection in greedy order with rank-one deflation.

    The whole pool competes unless both work-set sizes are given; then it is screened by the upper
    bound of the gain and by dissimilar modalities, and ``exact`` tells. Only coalitions of no, one
    and all modalities are drawn: all interactions add up to the value of the full one.
    """
    from . import greedy

    if not 0.0 <= eta <= 1.0:
        raise ValueError("eta must lie in [0, 1]")
    partners = max(1, partners)
    extra = closure_samples(labeled, modalities, closure, seed, fuser, lambda_alpha) if closure > 0 else None
    design = build(labeled, reference, labels, width, damping, extra)
    pool = candidates.select("id", "features", "p", "tokens")
    scored = pairwise_similarity(pool, modalities).join(upper_bound(pool, design), "id")
    scored = cut_lineage(scored.select("id", "bound", (F.lit(1.0) - F.col("similarity")).alias("proxy")))
    if workset is None or synergy_workset is None:
        union = scored.select("id", F.lit(True).alias("design_branch"), F.lit(True).alias("synergy_branch"))
        work = pool
    else:
        union = cut_lineage(rank_union(scored, "bound", "proxy", max(budget, workset), synergy_workset))
        work = cut_lineage(pool.join(union.select("id"), "id", "left_semi"))
    sizes = with_scalars(union.agg(F.count("*").alias("work")), scored.agg(F.count("*").alias("all"))).first()
    full = (1 << modalities) - 1
    masks = [0, *[1 << m for m in range(modalities)], full]
    cells = counterfactual_tokens(work, pool, modalities, partners, seed, masks, lambda_alpha)
    cells = cells.filter((F.col("coalition") != full) | (F.col("partner_no") == 0))  # all of them are the item itself
    fused = selection.with_fused(cells, fuser)
    place = F.array_position(F.array(*[F.lit(m) for m in masks]), F.col("coalition")).cast("int") - 1
    fused = fused.select("id", (place * partners + F.col("partner_no")).alias("cell"), "features", "p")
    kinds = [greedy.EMPTY] * partners + [greedy.SINGLE] * (partners * modalities) + [greedy.FULL]
    layout = greedy.Layout(tuple(kinds), modalities, eta)
    state = greedy.state_table(work, fused, design, layout)
    first = cut_lineage(greedy.scores(state, layout, width, greedy.Pending(labels)))
    wanted = min(budget, sizes["work"])
    picked = greedy.pick(state, design, layout, wanted, deflation_steps, fold_every)
    floors = [F.coalesce(c, F.col(f"_{c}") - F.lit(1.0)).alias(c) for c in ("additive", "synergy", "total_gain", "score")]
    least = first.agg(*[F.min("score").alias(f"_{c}") for c in ("additive", "synergy", "total_gain", "score")])
    marked = scored.select("id").join(first.withColumn("scored", F.lit(True)), "id", "left")
    marked = with_scalars(marked, least).select("id", F.coalesce("scored", F.lit(False)).alias("scored"), *floors)
    return DesignAcquired(picked.selection, marked, union_certificate(union), design.damping, sizes["work"] == sizes["all"], picked.exact)
