"""Exact ranks, running sums and quantiles that never put a whole key in one task.

A window over one huge key (or over no key at all) runs in a single task. Here the
ordering column is cut into ranges first: an approximate-quantile sketch yields at most
a few hundred bounds, a row's range is a compile-time comparison tree over them, range
totals are added up on a table of ``keys x ranges`` rows, and only then a window runs
inside each range. The bounds balance the work; the results do not depend on them.

One order holds everywhere, ascending or descending: numbers first, then NaN, then NULL;
ties ascend with NULL last. NULL keys are keys like others. Values are compared in their
own type, so large integers keep all their digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_RANGES = 256


def all_bounds(df: DataFrame, columns: list[str], ranges: int | None = None) -> list[list[float]]:
    """Distinct split points of each column from one pass; bounded lists for the driver."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = min(ranges or max(conf, 2), MAX_RANGES)
    cuts = [i / ranges for i in range(1, ranges)]
    row = df.select(
        *[
            F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), cuts, 20 * ranges).alias(f"b{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return [sorted({float(b) for b in (row[i] or []) if b is not None}) for i in range(len(columns))]


def range_bounds(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    return all_bounds(df, [column], ranges)[0]


def range_of(value: Column, bounds: list[float]) -> Column:
    """2i for values between bounds, 2i+1 for a value equal to bound i; NaN and NULL follow."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        bound = F.lit(bounds[mid])
        return (
            F.when(value < bound, tree(lo, mid))
            .when(value == bound, F.lit(2 * mid + 1))
            .otherwise(tree(mid + 1, hi))
        )

    last = 2 * len(bounds)
    odd = F.isnan(value.cast("double"))
    return F.when(value.isNull(), F.lit(last + 3)).when(odd, F.lit(last + 1)).otherwise(tree(0, len(bounds)))


def typed_bounds(df: DataFrame, column: str, bounds: list[float]) -> list:
    """Bounds as values of the column's own type: whole numbers for integer columns."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return sorted({max(-(2**63), min(2**63 - 1, int(b))) for b in bounds})
    return bounds


def sort_columns(df: DataFrame, order: str, tie: str, descending: bool = False) -> list[Column]:
    """The order of this module as sort columns."""
    c = F.col(order)
    main = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    if isinstance(df.schema[order].dataType, T.FractionalType) and descending:
        main.insert(0, F.isnan(c.cast("double")).asc_nulls_last())
        main.insert(0, c.isNull().asc())
    return [*main, F.col(tie).asc_nulls_last()]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the left side's key columns stay."""
    names = {k: f"_on_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in right.columns if c not in names])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(names[k]))
    return left.join(other, met, how).drop(*names.values())


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str],
    ranges: int | None = None,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Collapse to one row per (keys, order value) and attach exact running sums.

    For every name in ``sums`` the result has the value's own total, ``<name>_before``
    (strictly smaller order values) and ``<name>_all`` (the key's total). The collapsed
    table is stored once, so the bounds pass does not repeat the work above it; a caller
    that knows the bounds has stored its input already.
    """
    flat = df.groupBy(*keys, order).agg(*[F.sum(s).alias(s) for s in sums])
    if bounds is None:
        flat = cut_lineage(flat)
        bounds = range_bounds(flat, order, ranges)
    flat = flat.withColumn("_range", range_of(F.col(order).cast("double"), bounds))
    totals = flat.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    # One row per key and range: small, and spread over the keys where there are any.
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{s}").over(ahead), F.lit(0)).alias(f"_{s}_ahead") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = join_on(flat, totals, [*keys, "_range"])
    return joined.select(
        *keys,
        order,
        *sums,
        *[
            (F.col(f"_{s}_ahead") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_all" for s in sums],
    )


def rank_fraction(
    df: DataFrame, value: str, out: str, keys: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Tie-averaged ascending rank divided by the count of non-NULL values, in (0, 1].

    Every row stays; a NULL value has a NULL rank and counts for no other row. NaN is a value.
    """
    keys = keys or []
    base = cut_lineage(df.withColumn("_value", F.col(value).cast("double") + F.lit(0.0)))
    known = base.filter(F.col("_value").isNotNull())
    ranked = running_sums(
        known.select(*keys, "_value", F.lit(1).cast("bigint").alias("_n")),
        keys,
        "_value",
        ["_n"],
        bounds=range_bounds(base, "_value", ranges),
    )
    ranked = ranked.select(
        *keys,
        "_value",
        ((F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)) / F.col("_n_all")).alias(out),
    )
    return join_on(base, ranked, [*keys, "_value"], "left").drop("_value")


def row_ranks(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    out: str = "rank",
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key by (order, tie ascending), safe for huge keys.

    A value so frequent that it is itself a bound is split further by the tie column, and so are
    NaN and NULL.
    """
    base = cut_lineage(df)
    numeric = isinstance(base.schema[tie].dataType, T.NumericType)
    found = all_bounds(base, [order, tie] if numeric else [order], ranges)
    orders = typed_bounds(base, order, found[0])
    ties = typed_bounds(base, tie, found[1]) if numeric else []
    last, width = 2 * len(orders), 2 * len(ties) + 4
    main = range_of(F.col(order), orders)
    if descending:
        main = F.when(main <= last, F.lit(last) - main).otherwise(main)
    minor = range_of(F.col(tie), ties) if numeric else F.lit(0)
    base = base.withColumn("_main", main).withColumn(
        "_range",
        F.col("_main") * F.lit(width) + F.when(F.col("_main") % 2 == 1, minor).otherwise(F.lit(0)),
    )
    totals = base.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*sort_columns(base, order, tie, descending))
    return (
        join_on(base, totals, [*keys, "_range"])
        .withColumn(out, (F.col("_ahead") + F.row_number().over(inside)).cast("bigint"))
        .drop("_main", "_range", "_ahead")
    )


# A budget of picks up to this size is one TakeOrdered; beyond it ranks are distributed. Both
# plans give the same rows and ranks.
TOP_LIMIT = 100_000


def take_top(
    df: DataFrame, order: str, tie: str, n: int, descending: bool = True, out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows by (order, tie ascending) with their 1-based rank."""
    if n > TOP_LIMIT:
        ranked = row_ranks(df, [], order, tie, out, descending)
        return ranked.filter(F.col(out) <= n)
    by = sort_columns(df, order, tie, descending)
    top = df.orderBy(*by).limit(n)
    return top.withColumn(out, F.row_number().over(Window.orderBy(*by)).cast("bigint"))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rank correlation, NULL where either side is constant."""
    ranked = rank_fraction(rank_fraction(df.select(left, right), left, "_l"), right, "_r")
    spread = F.stddev_pop("_l") * F.stddev_pop("_r")
    return ranked.agg(
        F.when(spread > 1e-12, F.try_divide(F.covar_pop("_l", "_r"), spread)).alias("spearman")
    )


def key_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: DataFrame, share: str, out: str
) -> DataFrame:
    """Linear-interpolated quantile of the non-NULL values per key; the fraction comes from
    ``shares``, which has one row per label, which is a dimension, not data.
    """
    ranked = running_sums(
        df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"), F.lit(1).cast("bigint").alias("_n")),
        keys,
        "_value",
        ["_n"],
    )
    on = [k for k in keys if k in shares.columns]
    placed = join_on(ranked, shares.select(*on, F.col(share).alias("_share")), on).withColumn(
        "_at",
        F.greatest(F.least(F.col("_share"), F.lit(1.0)), F.lit(0.0)) * (F.col("_n_all") - 1),
    )
    end = F.col("_n_before") + F.col("_n")
    lower, upper = F.floor("_at"), F.ceil("_at")
    at_lower = (F.col("_n_before") <= lower) & (lower < end)
    at_upper = (F.col("_n_before") <= upper) & (upper < end)
    picked = (
        placed.filter(at_lower | at_upper)
        .groupBy(*keys)
        .agg(
            F.max(F.when(at_lower, F.col("_value"))).alias("_lo"),
            F.max(F.when(at_upper, F.col("_value"))).alias("_hi"),
            F.max("_at").alias("_at"),
        )
    )
    return picked.select(
        *keys,
        (F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo"))).alias(out),
    )
