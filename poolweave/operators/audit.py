"""Dataset audits: findings tables with one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import binary_flag, whole_number
from . import checks, metadata, splits, tabular


def split_table_findings(
    rows: DataFrame,
    label: str = "labels",
    arrays: dict[str, int] | None = None,
    expected_rows: int | None = None,
    require_positive: bool = True,
) -> DataFrame:
    """Audit of the assembled split table: columns, widths, labels, ids, size, leaks."""
    arrays = arrays or {}
    checks.require_columns(rows, ["stay_id", "subject_id", "partition", label, *arrays])
    positives = F.aggregate(F.col(label), F.lit(0), lambda a, x: a + x.cast("int"))
    rules = {
        "label not binary": F.exists(label, lambda x: ~x.isin(0, 1)),
        "subject id not positive": F.coalesce(F.col("subject_id") <= 0, F.lit(True)),
        "unknown split": ~F.coalesce(F.col("partition"), F.lit("")).isin(list(splits.SPLITS)),
    }
    if require_positive:
        rules["no positive label"] = positives == 0
    for name, width in arrays.items():
        rules[f"{name} has wrong width"] = F.size(name) != width
    parts = [
        checks.count_findings(rows, rules),
        checks.duplicate_count(rows, ["stay_id"], "stay listed twice"),
        splits.subject_leaks(rows)
        .agg(F.coalesce(F.sum("subjects"), F.lit(0)).alias("violations"))
        .select(F.lit("subject in several splits").alias("check"), "violations"),
        rows.agg((F.lit(len(splits.SPLITS)) - F.countDistinct("partition")).alias("violations")).select(
            F.lit("empty split").alias("check"), "violations"
        ),
    ]
    if expected_rows is not None:
        parts.append(
            rows.agg(F.abs(F.count("*") - F.lit(expected_rows)).alias("violations")).select(
                F.lit("row count differs").alias("check"), "violations"
            )
        )
    return checks.union_all(parts)


def release_findings(df: DataFrame, folds: list[int], expected: dict[str, int] | None = None) -> DataFrame:
    """Audit of a wide release: ids, labels, unique studies, folds, one fold per subject."""
    roles = tabular.column_roles(df.columns, expected)
    ident = lambda c: whole_number(F.col(c).cast("string"))
    bad_int = F.lit(False)
    for c in ("general_subject_id", "general_study_id", "general_strat_fold", "general_ecg_no_within_stay"):
        bad_int = bad_int | ident(c).isNull()
    bad_label = F.lit(False)
    for c in roles.diagnoses:
        bad_label = bad_label | binary_flag(F.col(c).cast("string")).isNull()
    bad_risk = F.lit(False)
    for c in roles.deterioration:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        bad_risk = bad_risk | ~text.isin("-999", "-999.0", "0", "0.0", "1", "1.0")
    rows = checks.count_findings(
        df,
        {
            "invalid integer": bad_int,
            "id not positive": (ident("general_subject_id") <= 0) | (ident("general_study_id") <= 0),
            "negative record number": ident("general_ecg_no_within_stay") < 0,
            "diagnosis label not binary": bad_label,
            "deterioration label invalid": bad_risk,
        },
    )
    wanted = F.array(*[F.lit(int(f)) for f in folds])
    seen = df.groupBy(ident("general_strat_fold").cast("int").alias("f")).agg(F.count("*").alias("n"))
    fold_rows = seen.agg(F.collect_set("f").alias("s")).select(
        F.lit("fold set differs").alias("check"),
        (F.size(F.array_except("s", wanted)) + F.size(F.array_except(wanted, F.col("s"))))
        .cast("bigint")
        .alias("violations"),
    )
    return checks.union_all(
        [
            rows,
            checks.duplicate_count(df, ["general_study_id"], "study listed twice"),
            fold_rows,
            checks.many_values_count(df, "general_subject_id", "general_strat_fold", "subject in several folds"),
        ]
    )


def source_findings(
    items: DataFrame, labels: list[str], files: DataFrame, item: str = "item_id", group: str = "group_id"
) -> DataFrame:
    """Audit of an item table against its file listing."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    not_binary = F.lit(False)
    for c in labels:
        not_binary = not_binary | ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    sides = metadata.one_sided(items, files, item)
    return checks.union_all(
        [
            checks.count_findings(
                items,
                {"empty item id": empty(item), "empty group id": empty(group), "label not binary": not_binary},
            ),
            checks.duplicate_count(items, [item], "item listed twice"),
            checks.long_counts(
                sides.agg(
                    F.count_if(F.col("side") == "missing").alias("item without file"),
                    F.count_if(F.col("side") == "extra").alias("file without item"),
                ),
                ["item without file", "file without item"],
            ),
        ]
    )


def prepared_findings(
    items: DataFrame, manifest: DataFrame, recorded: DataFrame, item: str = "item_id", group: str = "group_id"
) -> DataFrame:
    """Audit after preparation: unchanged source, full manifest, valid and single splits."""
    now = metadata.fingerprint(items)
    cols = ["rows", "xor", "total"]
    changed = now.exceptAll(recorded.select(*cols)).agg(F.count("*").alias("violations"))
    sides = metadata.one_sided(items, manifest, item).agg(F.count("*").alias("violations"))
    return checks.union_all(
        [
            changed.select(F.lit("source changed").alias("check"), "violations"),
            sides.select(F.lit("manifest differs from source").alias("check"), "violations"),
            checks.count_findings(
                manifest,
                {"unknown split": ~F.coalesce(F.col("partition"), F.lit("")).isin(list(splits.SPLITS))},
            ),
            checks.many_values_count(manifest, group, "partition", "group in several splits"),
        ]
    )


def same_ids_findings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set equality of two id lists: rows on one side only, counted per side."""
    a, b = left.select(key), right.select(key)
    only_left = a.exceptAll(b).agg(F.count("*").alias("violations"))
    only_right = b.exceptAll(a).agg(F.count("*").alias("violations"))
    return only_left.select(F.lit("only in left").alias("check"), "violations").unionByName(
        only_right.select(F.lit("only in right").alias("check"), "violations")
    )


def output_findings(outputs: DataFrame, ids: DataFrame, required: list[str], key: str = "id") -> DataFrame:
    """Model-output table of one role: columns, one row per id, exactly the given ids."""
    checks.require_columns(outputs, [key, *required])
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull()
    return checks.union_all(
        [
            checks.count_findings(outputs, {"required value missing": empty}),
            checks.duplicate_count(outputs, [key], "id listed twice"),
            outputs.join(ids.select(key), key, "left_anti")
            .agg(F.count("*").alias("violations"))
            .select(F.lit("id not requested").alias("check"), "violations"),
            ids.select(key)
            .join(outputs.select(key), key, "left_anti")
            .agg(F.count("*").alias("violations"))
            .select(F.lit("id without output").alias("check"), "violations"),
        ]
    )


def metric_input_findings(cells: DataFrame, labels: int) -> DataFrame:
    """Metric inputs (id, label, y, p): full rows, binary labels, finite scores."""
    rows = checks.count_findings(
        cells,
        {
            "label not binary": ~F.coalesce(F.col("y").isin(0, 1), F.lit(False)),
            "score not finite": F.coalesce(
                F.isnan("p") | F.col("p").isin(float("inf"), float("-inf")), F.lit(True)
            ),
        },
    )
    widths = cells.groupBy("id").agg(F.count("*").alias("c"))
    ragged = widths.agg(F.count_if(F.col("c") != labels).alias("violations"))
    return rows.unionByName(ragged.select(F.lit("row has wrong label count").alias("check"), "violations"))
