"""Label prototypes, prototype similarity and the prototype-evidence selection rule."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, unit
from ..functions.ranks import take_top
from ..functions.vectors import BROADCAST_BYTES, unit_rows, vector_sum
from ..session import cut_lineage

BACKGROUND = -1


def stacked_views(rows: DataFrame, multi: bool) -> DataFrame:
    """Views of an item: its modality tokens plus the fused vector as the last view."""
    fused = F.array(F.transform("features", lambda x: x.cast("double")))
    if not multi:
        return rows.withColumn("views", fused)
    tokens = F.transform("tokens", lambda t: F.transform(t, lambda x: x.cast("double")))
    return rows.withColumn("views", F.concat(tokens, fused))


def refresh_prototypes(labeled: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(view, label, vec, n): normalised sums of unit vectors over each label's positives.

    The shared background (label -1) sums every (item, negative label) pair, so an item
    enters once with the weight "number of its negative labels". A label without
    positives keeps its old vector.
    """
    seen = labeled.select(F.posexplode("views").alias("view", "vec"), "y").withColumn("vec", unit(F.col("vec")))
    hot = F.transform("y", lambda v, i: F.when(v >= 0.5, F.struct(i.alias("label"), F.lit(1.0).alias("w"))))
    negatives = F.aggregate("y", F.lit(0.0), lambda a, v: a + F.when(v >= 0.5, F.lit(0.0)).otherwise(F.lit(1.0)))
    rest = F.array(F.struct(F.lit(BACKGROUND).alias("label"), negatives.alias("w")))
    keyed = seen.withColumn("k", F.explode(F.concat(F.filter(hot, lambda h: h.isNotNull()), rest)))
    keyed = keyed.filter(F.col("k.w") > 0).select(
        "view",
        F.col("k.label").cast("int").alias("label"),
        F.col("k.w").alias("w"),
        F.transform("vec", lambda x: x * F.col("k.w")).alias("vec"),
    )
    fresh = keyed.groupBy("view", "label").agg(
        unit(vector_sum("vec")).alias("vec"), F.sum("w").cast("bigint").alias("n")
    )
    if old is None:
        return fresh
    kept = old.select("view", "label", "vec").join(fresh, ["view", "label"], "left_anti")
    return fresh.unionByName(kept.withColumn("n", F.lit(0).cast("bigint")))


def refresh_label_latents(latents: DataFrame) -> DataFrame:
    """Prototypes from label-specific latents (id, view, label, vec, y)."""
    key = F.when(F.col("y") >= 0.5, F.col("label")).otherwise(F.lit(BACKGROUND)).cast("int")
    return (
        latents.select("view", key.alias("label"), unit(F.col("vec")).alias("vec"))
        .groupBy("view", "label")
        .agg(unit(vector_sum("vec")).alias("vec"), F.count("*").alias("n"))
    )


def label_latent_similarity(latents: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Own similarity of label-specific latents: a join by (view, label) and a dot product."""
    protos = prototypes.select("view", "label", F.col("vec").alias("_proto"))
    return latents.join(protos, ["view", "label"]).select(
        "id", "view", "label", dot(unit(F.col("vec")), F.col("_proto")).alias("own")
    )


def _bank(prototypes: DataFrame, labels: range) -> list[np.ndarray]:
    """Prototype matrices per view of some labels, the background last; a bounded dimension."""
    wanted = (F.col("label") == BACKGROUND) | F.col("label").between(labels.start, labels.stop - 1)
    by_view: dict[int, dict[int, list[float]]] = defaultdict(dict)
    for r in prototypes.filter(wanted).select("view", "label", "vec").collect():
        by_view[r["view"]][r["label"]] = r["vec"]
    bank = []
    for v in range(max(by_view) + 1):
        matrix = np.zeros((len(labels) + 1, max((len(x) for x in by_view[v].values()), default=0)))
        for label, vec in by_view[v].items():
            matrix[-1 if label == BACKGROUND else label - labels.start] = vec
        bank.append(matrix)
    return bank


def with_similarity(rows: DataFrame, prototypes: DataFrame, labels: int) -> DataFrame:
    """Attach ``view_own`` [V][L], ``own`` (last view) and ``background`` [V] to each row.

    The prototype bank (views x labels x width) is a fitted dimension and travels with the tasks,
    in one pass while it fits BROADCAST_BYTES, else in a pass for each slice of labels that does.
    """
    size = prototypes.agg(F.sum(F.size("vec")) * 8).first()[0] or 0
    step = max(1, labels // max(1, -(-size // BROADCAST_BYTES)))
    slices = [range(i, min(i + step, labels)) for i in range(0, labels, step)]
    for number, mine in enumerate(slices):
        rows = _similarity_slice(rows, _bank(prototypes, mine), first=number == 0)
        if number + 1 < len(slices):
            rows = cut_lineage(rows)
    return rows


def _similarity_slice(rows: DataFrame, bank: list[np.ndarray], first: bool) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name not in ("view_own", "own", "background")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", view_own array<array<double>>, own array<double>, background array<double>"

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sims = []
            for v, matrix in enumerate(bank):
                x = np.stack([np.asarray(row[v], dtype=np.float64) for row in batch["views"]])
                sims.append(unit_rows(x) @ matrix.T)
            found, background = np.stack([s[:, :-1] for s in sims], axis=1), np.stack([s[:, -1] for s in sims], axis=1)
            if not first:
                before = np.stack([np.stack([np.asarray(x, dtype=np.float64) for x in row]) for row in batch["view_own"]])
                found = np.concatenate([before, found], axis=2)
            yield batch.assign(view_own=found.tolist(), own=found[:, -1].tolist(), background=background.tolist())

    return rows.mapInPandas(run, schema)


def positive_thresholds(labeled: DataFrame) -> DataFrame:
    """(label, threshold): midpoint of the positives' similarity range, 0 without any."""
    cells = labeled.select(F.posexplode(F.arrays_zip("y", "own")).alias("label", "c"))
    positive = F.col("c.y") >= 0.5
    mid = (F.min(F.when(positive, F.col("c.own"))) + F.max(F.when(positive, F.col("c.own")))) / F.lit(2.0)
    return cells.groupBy("label").agg(F.coalesce(mid, F.lit(0.0)).alias("threshold"))


def expected_cardinality(labeled: DataFrame) -> float:
    row = labeled.agg(F.avg(F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double")))).first()
    return float(row[0])


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def evidence_scores(rows: DataFrame, thresholds: list[float], expected: float) -> DataFrame:
    """Inverse positive evidence times cardinality mismatch, both under a square root."""
    labels = len(thresholds)
    over = F.zip_with(
        "own", F.array(*[F.lit(float(t)) for t in thresholds]), lambda s, t: (s > t).cast("double")
    )
    evidence = F.zip_with(
        "p",
        "own",
        lambda p, s: F.when(
            p >= 0.5, F.greatest((s + F.lit(1.0)) * F.lit(0.5), F.lit(1e-10))
        ).otherwise(F.lit(0.0)),
    )
    return (
        rows.withColumn("inverse_positive_evidence", F.lit(1.0) / (_sum(evidence) + F.lit(labels * 1e-10)))
        .withColumn("prototype_positive_count", _sum(over))
        .withColumn("cardinality_mismatch", F.abs(F.col("prototype_positive_count") - F.lit(float(expected))))
        .withColumn(
            "combined", F.sqrt("inverse_positive_evidence") * F.sqrt("cardinality_mismatch")
        )
    )


def weighted_scores(
    rows: DataFrame,
    expected: float,
    uncertainty: float = 0.5,
    novelty: float = 0.35,
    cardinality: float = 0.15,
) -> DataFrame:
    """Weighted sum of uncertainty, prototype novelty and cardinality mismatch."""
    size = F.size("p").cast("double")
    best = F.array_position("p", F.array_max("p")) - 1
    chosen = F.transform("p", lambda p, i: ((p >= 0.5) | (i == best)).cast("double"))
    picked = F.zip_with("own", "_chosen", lambda s, c: s * c)
    rows = rows.withColumn("_chosen", chosen)
    out = (
        rows.withColumn("uncertainty", _sum(F.transform("p", lambda p: F.lit(1.0) - F.abs(F.lit(2.0) * p - F.lit(1.0)))) / size)
        .withColumn(
            "prototype_novelty",
            F.greatest(
                F.least(
                    (F.lit(1.0) - _sum(picked) / F.greatest(_sum(F.col("_chosen")), F.lit(1.0))) * F.lit(0.5),
                    F.lit(1.0),
                ),
                F.lit(0.0),
            ),
        )
        .withColumn(
            "cardinality_mismatch", F.abs(_sum(F.col("p")) - F.lit(float(expected))) / F.greatest(size, F.lit(1.0))
        )
    )
    return out.withColumn(
        "combined",
        F.lit(uncertainty) * F.col("uncertainty")
        + F.lit(novelty) * F.col("prototype_novelty")
        + F.lit(cardinality) * F.col("cardinality_mismatch"),
    ).drop("_chosen")


def threshold_list(thresholds: DataFrame, labels: int) -> list[float]:
    """Per-label thresholds as a list: one number per label of the dimension."""
    found = {r["label"]: r["threshold"] for r in thresholds.collect()}
    return [float(found.get(i, 0.0)) for i in range(labels)]


def acquire(
    candidates: DataFrame,
    labeled: DataFrame,
    budget: int,
    labels: int,
    multi_view: bool = False,
    scores: bool = False,
) -> DataFrame:
    """Fit prototypes on the labeled rows, attach evidence to the pool, take the top rows."""
    labeled = stacked_views(labeled, multi_view)
    bank = cut_lineage(refresh_prototypes(labeled))
    measured = with_similarity(labeled, bank, labels)
    limits = threshold_list(positive_thresholds(measured), labels)
    pool = with_similarity(stacked_views(candidates, multi_view), bank, labels)
    scored = evidence_scores(pool, limits, expected_cardinality(labeled)).select(
        "id", "inverse_positive_evidence", "cardinality_mismatch", "prototype_positive_count", "combined"
    )
    return scored if scores else take_top(scored, "combined", "id", budget)
