"""Thresholded multi-label metrics over long predictions (id, label, y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from .ranking_metrics import areas_of, ranking_metrics, score_table

# 26 equally spaced thresholds on [0, 1].
GRID = [i / 25 for i in range(26)]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def fit_thresholds(cells: DataFrame) -> DataFrame:
    """Best F1 threshold per label on the grid, ties to the one nearest .5 (the lower first).

    One aggregate with 2 x 26 conditional counts per label: rows are never multiplied.
    """
    y = F.col("y") == 1
    aggs = [F.count_if(y).alias("pos"), F.count("*").alias("n")]
    for i, t in enumerate(GRID):
        aggs.append(F.count_if(y & (F.col("p") >= t)).alias(f"tp{i}"))
        aggs.append(F.count_if(F.col("p") >= t).alias(f"pp{i}"))
    counts = cells.groupBy("label").agg(*aggs)
    scored = F.array(
        *[
            F.struct(
                _ratio(F.lit(2.0) * F.col(f"tp{i}"), F.col("pos") + F.col(f"pp{i}")).alias("f1"),
                F.lit(-abs(t - 0.5)).alias("near"),
                F.lit(-i).alias("low"),
                F.lit(t).alias("t"),
            )
            for i, t in enumerate(GRID)
        ]
    )
    best = F.array_max(scored)["t"]
    one_class = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    return counts.select("label", F.when(one_class, F.lit(0.5)).otherwise(best).alias("threshold"))


def confusion(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion counts per label from a score table (label, p, pos, neg)."""
    hit = F.col("p") >= F.col("threshold")
    total = lambda of, c: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
    return (
        counts.join(F.broadcast(thresholds), "label")
        .groupBy("label")
        .agg(
            F.first("threshold").alias("threshold"),
            total(hit, "pos").alias("tp"),
            total(hit, "neg").alias("fp"),
            total(~hit, "pos").alias("fn"),
            total(~hit, "neg").alias("tn"),
        )
    )


def label_details(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per label: support, threshold, areas and every thresholded rate; the cells are made once."""
    counts, bounds = score_table(cells)
    c = confusion(counts, thresholds)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rates = c.select(
        "label",
        "threshold",
        (tp + fn).alias("support"),
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
        (tn / F.greatest(tn + fp, F.lit(1))).alias("specificity"),
        (tn / F.greatest(tn + fn, F.lit(1))).alias("npv"),
    )
    return rates.join(areas_of(counts, bounds).select("label", "auroc", "auprc"), "label")


def threshold_metrics(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: macro/micro F1, macro precision and recall, subset accuracy, Hamming loss.

    The cells are built and read once: grouping sets count per label and per item together.
    """
    hit, y = F.col("p") >= F.col("threshold"), F.col("y") == 1
    both = cells.join(F.broadcast(thresholds), "label").groupingSets([["label"], ["id"]], "label", "id")
    counts = both.agg(
        F.count_if(y & hit).alias("tp"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(~y & ~hit).alias("tn"),
        F.grouping("id").alias("of_label"),
    )
    tp, fp, fn, tn = (F.when(F.col("of_label") == 1, F.col(x)) for x in ("tp", "fp", "fn", "tn"))
    all_right = F.when(F.col("of_label") == 0, (F.col("fp") + F.col("fn") == 0).cast("double"))
    of_label = lambda ratio: F.avg(F.when(F.col("of_label") == 1, ratio))
    return counts.agg(
        of_label(_ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)).alias("macro_f1"),
        _ratio(F.lit(2.0) * F.sum(tp), F.lit(2.0) * F.sum(tp) + F.sum(fp) + F.sum(fn)).alias("micro_f1"),
        of_label(_ratio(tp, tp + fp)).alias("macro_precision"),
        of_label(_ratio(tp, tp + fn)).alias("macro_recall"),
        (F.sum(fp + fn) / F.sum(tp + fp + fn + tn)).alias("hamming_loss"),
        F.avg(all_right).alias("subset_accuracy"),
    )


def all_metrics(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    return with_scalars(
        threshold_metrics(cells, thresholds),
        ranking_metrics(cells).select("macro_auroc", "micro_auroc", "macro_auprc", "micro_auprc"),
    )
