"""Mixup pairs over a labeled table and the virtual rows they produce."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..session import cut_lineage
from ..functions.columns import blend, uniform
from ..functions.ranks import all_bounds, key_quantiles, range_of, row_ranks, running_sums
from .checks import require


class Mixing(NamedTuple):
    """How virtual rows come about. ``shape``: of the symmetric Beta weights; ``by_mass``: partners
    by positive mass instead of uniformly; ``sparse_share``: anchors are the rows up to this quantile
    of positives; ``anchor_leads``: the anchor gets the larger weight."""

    shape: float = 0.4
    by_mass: bool = True
    sparse_share: float = 0.5
    anchor_leads: bool = True

    def checked(self) -> "Mixing":
        require(self.shape > 0, "Beta weights have a shape above 0")
        require(0 < self.sparse_share <= 1, "the share of sparse rows is in (0, 1]")
        return self


@lru_cache(maxsize=16)
def _beta_table(alpha: float, points: int = 20001) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative half of Beta(a, a) on [0, 1/2] over s = x**a, where it has no pole."""
    s = np.linspace(0.0, 0.5**alpha, points)
    density = (1.0 - s ** (1.0 / alpha)) ** (alpha - 1.0)
    area = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(s))])
    return area / area[-1] / 2, s


def beta_quantile(u: np.ndarray, alpha: float) -> np.ndarray:
    """Quantile of the symmetric Beta(a, a) distribution."""
    half, s = _beta_table(float(alpha))
    low = np.minimum(u, 1.0 - u)
    x = np.interp(low, half, s) ** (1.0 / alpha)
    return np.where(u <= 0.5, x, 1.0 - x)


def beta_draw(u: Column, alpha: float) -> Column:
    @F.pandas_udf("double")
    def draw(values: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(values.to_numpy(), alpha))

    return draw(u)


def positives_of(labeled: DataFrame) -> DataFrame:
    return labeled.withColumn(
        "positives", F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double"))
    )


def anchors(labeled: DataFrame, quantile: float) -> DataFrame:
    """Items at or below the positive-count quantile."""
    rows = positives_of(labeled)
    if quantile >= 1.0:
        return rows
    share = labeled.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(quantile).alias("share"))
    cut = key_quantiles(rows.select(F.lit(0).alias("k"), "positives"), ["k"], "positives", share, "share", "_cut")
    return with_scalars(rows, cut.select("_cut")).filter(F.col("positives") <= F.col("_cut")).drop("_cut")


def plan(labeled: DataFrame, rule: Mixing, seed: int) -> DataFrame:
    """(anchor_id, partner_id, lam): partners by positive mass or uniformly, Beta weights.

    A mass-proportional partner is found in two exact steps: the draw first picks a class of equal
    mass by the classes' running totals, then a member of the class by its position. Draws and
    class bounds are cut into the same ranges of [0, 1), so both steps are equi-joins, with a
    comparison inside a range only.
    """
    rule.checked()
    anchor = anchors(labeled, rule.sparse_share).select("id")
    rows = positives_of(labeled).select("id", F.greatest("positives", F.lit(1.0)).alias("mass"))
    if rule.by_mass:
        sized = rows.withColumn("weight", F.col("mass")).withColumn("n", F.lit(1).cast("bigint"))
        classes = cut_lineage(
            running_sums(sized, [], "mass", ["weight", "n"]).select(
                "mass",
                "n",
                (F.col("weight_before") / F.col("weight_all")).alias("lo"),
                (F.col("weight") / F.col("weight_all")).alias("width"),
            )
        )
        bounds = all_bounds(classes, ["lo"])[0]
        first, last = range_of(F.col("lo"), bounds), range_of(F.col("lo") + F.col("width"), bounds)
        placed_classes = classes.withColumn("_range", F.explode(F.sequence(first, last)))
        members = row_ranks(rows, ["mass"], "id", "id", "pos")
        drawn = anchor.withColumn("_u", uniform(seed, "partner", "id"))
        drawn = drawn.withColumn("_range", range_of(F.col("_u"), bounds))
        placed = drawn.join(placed_classes, "_range").filter(
            (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("lo") + F.col("width"))
        )
        at = F.least(F.floor((F.col("_u") - F.col("lo")) / F.col("width") * F.col("n")), F.col("n") - 1) + 1
        pairs = placed.select(F.col("id").alias("anchor_id"), "mass", at.cast("bigint").alias("pos")).join(
            members.select("mass", "pos", F.col("id").alias("partner_id")), ["mass", "pos"]
        )
    else:
        members = row_ranks(rows, [], "id", "id", "pos")
        size = rows.agg(F.count("*").alias("_n"))
        step = F.floor(uniform(seed, "partner", "id") * (F.col("_n") - 1)) + 1
        placed = with_scalars(members.join(anchor, "id", "left_semi"), size)
        target = ((F.col("pos") - 1 + step) % F.col("_n") + 1).cast("bigint")
        pairs = placed.select(F.col("id").alias("anchor_id"), target.alias("pos")).join(
            members.select("pos", F.col("id").alias("partner_id")), "pos"
        )
    pairs = pairs.filter(F.col("anchor_id") != F.col("partner_id"))
    lam = beta_draw(uniform(seed, "lambda", "anchor_id"), rule.shape)
    if rule.anchor_leads:
        pairs = pairs.withColumn("lam", lam)
        return pairs.select("anchor_id", "partner_id", F.greatest("lam", F.lit(1.0) - F.col("lam")).alias("lam"))
    return pairs.select("anchor_id", "partner_id", lam.alias("lam"))


def virtual_rows(labeled: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Mixed vectors and labels of each pair; all columns share the pair's weight."""
    wanted = [*columns, "y"]
    a = labeled.select(F.col("id").alias("anchor_id"), *[F.col(c).alias(f"_a_{c}") for c in wanted])
    b = labeled.select(F.col("id").alias("partner_id"), *[F.col(c).alias(f"_b_{c}") for c in wanted])
    both = pairs.join(a, "anchor_id").join(b, "partner_id")
    mixed = [blend(F.col(f"_a_{c}"), F.col(f"_b_{c}"), F.col("lam")).alias(c) for c in wanted]
    return both.select("anchor_id", "partner_id", "lam", *mixed)


def virtual_tokens(labeled: DataFrame, pairs: DataFrame, modalities: int) -> DataFrame:
    """Mixup of every modality token with one shared plan."""
    rows = labeled.select("id", "y", *[F.element_at("tokens", m + 1).alias(f"t{m}") for m in range(modalities)])
    names = [f"t{m}" for m in range(modalities)]
    out = virtual_rows(rows, pairs, names)
    return out.select("anchor_id", "partner_id", "lam", F.array(*names).alias("tokens"), "y")


def plan_summary(labeled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Anchor share, mean weight and mean positives of anchors and mixed rows."""
    pos = positives_of(labeled).select("id", "positives")
    size = labeled.agg(F.count("*").alias("_n"))
    a = pos.select(F.col("id").alias("anchor_id"), F.col("positives").alias("_pa"))
    b = pos.select(F.col("id").alias("partner_id"), F.col("positives").alias("_pb"))
    mixed = F.col("lam") * F.col("_pa") + (F.lit(1.0) - F.col("lam")) * F.col("_pb")
    row = pairs.join(a, "anchor_id").join(b, "partner_id").agg(
        F.count("*").alias("virtual_rows"),
        F.avg("lam").alias("mean_lambda"),
        F.avg("_pa").alias("anchor_positive_mean"),
        F.avg(mixed).alias("mixed_positive_mean"),
    )
    return with_scalars(row, size).withColumn("anchor_fraction", F.col("virtual_rows") / F.col("_n")).drop("_n")
