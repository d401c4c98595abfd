"""Sinks and manifests: predictions, shards, label matrices, metric tables."""

from __future__ import annotations

import platform
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..operators.labels import label_matrix, positive_counts
from ..operators.resolution import metric_matrix

SCHEMA_VERSION = 1


def write_predictions(cells: DataFrame, path: str) -> None:
    """Aligned (id, label, y, p) per arm and split; the keys travel with every value."""
    checks.require_columns(cells, ["arm", "split", "id", "label", "y", "p"])
    checks.write_new(cells, path, ["arm", "split"])


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    rows.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of a written table, read from file metadata columns only.

    Rows are counted by whole path; the name is cut out once a file, not once a row.
    """
    per_path = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    return per_path.groupBy(F.substring_index("path", "/", -1).alias("file")).agg(F.sum("n").alias("rows"))


def table_manifest(rows: DataFrame, arrays: list[str], split: str = "partition") -> DataFrame:
    """One row: total rows, rows per split, and the width of each array column."""
    per = rows.groupBy(split).agg(
        F.count("*").alias("n"), *[F.max(F.size(a)).alias(f"{a}_width") for a in arrays]
    )
    return per.agg(
        F.sum("n").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("split_rows"),
        *[F.max(f"{a}_width").alias(f"{a}_width") for a in arrays],
    )


def write_label_matrix(items: DataFrame, positives: DataFrame, names: list[str], path: str) -> None:
    """Wide 0/1 matrix plus the positive counts per label."""
    checks.write_new(label_matrix(items, positives, names), f"{path}/matrix")
    checks.write_new(positive_counts(positives), f"{path}/counts")


def write_metric_matrix(runs: list[DataFrame], path: str) -> DataFrame:
    """Cross-run table with the union of columns; CSV or JSON by the path's suffix."""
    table = metric_matrix(runs)
    writer = table.coalesce(1).write.mode("errorifexists")
    if path.lower().endswith(".json"):
        writer.json(path)
    else:
        writer.option("header", True).csv(path)
    return table


def revision(folder: str = ".") -> str:
    try:
        out = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
        return out.stdout.strip() or "unknown"
    except OSError:
        return "unknown"


def run_manifest(
    spark: SparkSession, task: str, method: str | None, settings: dict[str, str], folder: str = "."
) -> DataFrame:
    """One row: schema version, task, method, revision, runtime and resolved settings."""
    pairs = [F.lit(x) for k, v in sorted(settings.items()) for x in (k, str(v))]
    return spark.range(1).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(task).alias("task"),
        F.lit(method).alias("method"),
        F.lit(revision(folder)).alias("revision"),
        F.lit(platform.python_version()).alias("python"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("settings"),
    )


def write_run_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("errorifexists").json(path)
