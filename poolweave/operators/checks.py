"""Findings tables: every audit lists what is wrong; strict mode raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    pass


def require(holds: bool, rule: str) -> None:
    """For settings: state the rule that is broken."""
    if not holds:
        raise ValueError(f"not met: {rule}")


def count_findings(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: (check, violations) for each row-level rule."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return long_counts(row, list(rules))


def long_counts(row: DataFrame, names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into (check, violations) rows."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("violations")) for n in names]
    )
    return row.select(F.explode(pairs).alias("f")).select("f.check", "f.violations")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_count(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Number of key values that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .agg(F.count_if(F.col("_n") > 1).alias("violations"))
        .select(F.lit(check).alias("check"), "violations")
    )


def many_values_count(df: DataFrame, key: str, value: str, check: str) -> DataFrame:
    """Number of keys that carry more than one distinct value."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        .agg(F.count_if(F.col("_a") != F.col("_b")).alias("violations"))
        .select(F.lit(check).alias("check"), "violations")
    )


def enforce(findings: DataFrame) -> None:
    """Raise when any check has violations (a findings table has one row per check)."""
    bad = findings.filter(F.col("violations") > 0).orderBy("check").limit(20).collect()
    if bad:
        raise AuditError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AuditError(f"missing columns: {missing}")


def write_new(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet write that refuses to touch an existing artifact."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
