"""Scenario views: label subsets and withheld modalities over a labeled table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..functions.columns import blank_tokens, uniform
from ..functions.ranks import row_ranks
from ..session import cut_lineage
from . import checks
from .labels import frequency_ranks


def label_subset(
    names: DataFrame, train_positives: DataFrame, drop_top: int = 0, minimum: int = 0
) -> DataFrame:
    """Label dimension with frequency, rank and the keep flag; ranks use train rows only."""
    ranked = frequency_ranks(train_positives, names)
    keep = (F.col("freq_rank") > drop_top) & (F.col("positives") >= minimum)
    return ranked.withColumn("kept", keep)


def subset_report(subset: DataFrame) -> DataFrame:
    kept_mass = F.sum(F.when(F.col("kept"), F.col("positives")).otherwise(F.lit(0)))
    return subset.agg(
        F.count_if("kept").alias("kept_labels"),
        F.count_if(~F.col("kept")).alias("dropped_labels"),
        (F.lit(1.0) - kept_mass / F.greatest(F.sum("positives"), F.lit(1))).alias("dropped_mass"),
    )


@dataclass(frozen=True)
class Withhold:
    """Target share of rows that lose one modality."""

    modality: str
    rate: float
    bias: str = "uniform"
    strength: float = 1.0
    seed: int = 0
    unit: int | None = None
    splits: tuple[str, ...] = ("train", "val", "test")


def weights(rows: DataFrame, how: Withhold) -> DataFrame:
    """Selection weight per eligible row: uniform, by label count, or by care unit."""
    if how.bias == "uniform":
        return rows.withColumn("weight", F.lit(1.0))
    if how.bias == "label_sparse":
        spread = rows.groupBy("partition").agg(
            F.avg("positives").alias("_mean"), F.stddev_pop("positives").alias("_std")
        )
        z = (F.col("positives") - F.col("_mean")) / F.col("_std")
        return (
            rows.join(F.broadcast(spread), "partition")
            .withColumn(
                "weight", F.when(F.col("_std") > 0, F.exp(F.lit(-how.strength) * z)).otherwise(F.lit(1.0))
            )
            .drop("_mean", "_std")
        )
    if how.bias == "careunit":
        if how.unit is None:
            raise ValueError("bias 'careunit' needs the affected unit")
        boosted = F.lit(max(how.strength, 0.0) + 1.0)
        return rows.withColumn(
            "weight", F.when(F.col("unit_code") == how.unit, boosted).otherwise(F.lit(1.0))
        )
    raise ValueError(f"unknown bias {how.bias!r}")


def withheld(rows: DataFrame, how: Withhold, available: str, disjoint_from: str | None = None) -> DataFrame:
    """Rows with the flag ``<modality>_missing``: natural gaps plus weighted extra rows.

    Per split ``round_half_even(rate * rows) - natural`` further rows are drawn without
    replacement. An exponential race gives each row the key -ln(u) / weight; the smallest
    keys win, and their exact rank comes from range-wise ranks, never from one task.
    """
    out = f"{how.modality}_missing"
    if how.rate <= 0:
        return rows.withColumn(out, ~F.col(available))
    in_scope = F.col("partition").isin(list(how.splits))
    sizes = rows.filter(in_scope).groupBy("partition").agg(
        (F.bround(F.lit(how.rate) * F.count("*")) - F.count_if(~F.col(available))).alias("_wanted")
    )
    free = in_scope & F.col(available)
    if disjoint_from:
        free = free & ~F.col(disjoint_from)
    eligible = weights(rows.filter(free), how)
    eligible = eligible.withColumn(
        "_key", -F.log(uniform(how.seed, f"{how.modality}-missing", "id")) / F.col("weight")
    )
    ranked = row_ranks(eligible.select("id", "partition", "_key"), ["partition"], "_key", "id", "_rank")
    chosen = (
        ranked.join(F.broadcast(sizes), "partition")
        .filter(F.col("_rank") <= F.col("_wanted"))
        .select("id", F.lit(True).alias("_chosen"))
    )
    return (
        rows.join(chosen, "id", "left")
        .withColumn(out, ~F.col(available) | F.coalesce("_chosen", F.lit(False)))
        .drop("_chosen")
    )


def scenario_summary(rows: DataFrame, modalities: list[str]) -> DataFrame:
    """Missing rows and rates per modality, and rows that lost every one of them."""
    flags = [F.col(f"{m}_missing") for m in modalities]
    aggs = [F.count("*").alias("rows")]
    for m, f in zip(modalities, flags):
        aggs += [
            F.count_if(f).alias(f"{m}_missing_rows"),
            F.avg(f.cast("double")).alias(f"{m}_missing_rate"),
        ]
    both: Column = F.lit(True)
    for f in flags:
        both = both & f
    return rows.agg(*aggs, F.count_if(both).alias("both_missing_rows"))


def resolve(
    rows: DataFrame,
    names: DataFrame,
    train_positives: DataFrame,
    drop_top: int = 0,
    minimum: int = 0,
    notes: Withhold | None = None,
    series: Withhold | None = None,
    disjoint: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The declared scenario: (rows with missing flags, label subset).

    A draw reads its rows three times (sizes, eligible rows, flags), so they are stored before each.
    """
    out = rows
    if notes:
        out = withheld(cut_lineage(out), notes, "notes_available")
    if series:
        out = withheld(cut_lineage(out), series, "series_available", "notes_missing" if disjoint and notes else None)
    return out, label_subset(names, train_positives, drop_top, minimum)


def apply_view(rows: DataFrame, subset: DataFrame, note_length: int, series: str = "x", label: str = "labels") -> DataFrame:
    """Blank withheld notes, zero withheld series, keep the subset's label positions."""
    keep = [r["ord"] for r in subset.filter("kept").orderBy("ord").select("ord").collect()]
    if not keep:
        raise checks.AuditError("the label subset removed every label")
    out = rows
    for name, blank in blank_tokens(note_length).items():
        out = out.withColumn(name, F.when(F.col("notes_missing"), blank).otherwise(F.col(name)))
    zero = F.transform(series, lambda x: F.lit(0.0).cast("float"))
    out = out.withColumn(series, F.when(F.col("series_missing"), zero).otherwise(F.col(series)))
    out = out.withColumn(label, F.array(*[F.element_at(label, i + 1) for i in keep]))
    return out.withColumn("notes_available", ~F.col("notes_missing")).withColumn(
        "series_available", ~F.col("series_missing")
    )


def scenario_report(rows: DataFrame, prior_recall: DataFrame, labels: int) -> DataFrame:
    """Train-prior recall, label count, positives per visit, withheld versus present.

    ``rows`` needs positives, partition and notes_missing; ``prior_recall`` has one row.
    """
    train = rows.filter(F.col("partition") == "train")
    row = train.agg(
        F.count("*").alias("train_rows"),
        F.avg("positives").alias("positives_per_visit"),
        F.avg(F.col("notes_missing").cast("double")).alias("notes_withheld"),
        F.avg(F.when(F.col("notes_missing"), F.col("positives"))).alias("withheld_positives"),
        F.avg(F.when(~F.col("notes_missing"), F.col("positives"))).alias("present_positives"),
    )
    return with_scalars(row, prior_recall).withColumn("labels", F.lit(labels))
