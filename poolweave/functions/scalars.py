"""One-row results as columns, through a scalar subquery instead of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row; more rows are an error."""
    names = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("s")).scalar()
    tagged = df.withColumn("_scalars", packed)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return tagged.select(*kept, *[F.col(f"_scalars.`{n}`").alias(n) for n in names])
