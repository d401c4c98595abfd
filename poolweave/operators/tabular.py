"""Wide release tables: roles by name, train-only fit, one generated projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import code_of, hot_index
from . import checks

# Column prefixes and suffixes that give a column its role.
FEATURE_PREFIXES = ("demographics_", "biometrics_", "vitals_", "labvalues_")
MASK_SUFFIXES = ("_nan", "_m")
ONE_HOT_PREFIX = "demographics_ethnicity_"
ONE_HOT_COLUMN = "demographics_ethnicity"
ACUITY = "vitals_acuity"
REQUIRED = (
    "general_subject_id",
    "general_study_id",
    "general_strat_fold",
    "general_ecg_no_within_stay",
    "general_data",
)
TRAIN_FOLDS, VALIDATION_FOLD, TEST_FOLD = 18, 18, 19
CARDINALITY_LIMIT = 10
MISSING_LABEL = -999


@dataclass(frozen=True)
class Roles:
    diagnoses: list[str]
    deterioration: list[str]
    features: list[str]
    masks: list[str]


@dataclass
class TableSpec:
    """Fitted transform: a small record of names, medians and categories."""

    features: list[str]
    inputs: list[str]
    medians: dict[str, float]
    categories: dict[str, list[float]]
    masks: list[str]
    continuous: list[str]
    diagnoses: list[str] = field(default_factory=list)
    deterioration: list[str] = field(default_factory=list)


def column_roles(columns: list[str], expected: dict[str, int] | None = None) -> Roles:
    """Roles from header names only; ``expected`` gives the counts to enforce."""
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise checks.AuditError(f"missing required columns: {missing}")
    features = [c for c in columns if c.startswith(FEATURE_PREFIXES)]
    roles = Roles(
        diagnoses=[c for c in columns if c.startswith("diagnoses_")],
        deterioration=[c for c in columns if c.startswith("deterioration_")],
        features=[c for c in features if not c.endswith(MASK_SUFFIXES)],
        masks=[c for c in features if c.endswith(MASK_SUFFIXES)],
    )
    for name, wanted in (expected or {}).items():
        found = len(getattr(roles, name))
        if found != wanted:
            raise checks.AuditError(f"expected {wanted} {name}, found {found}")
    return roles


def input_columns(features: list[str]) -> list[str]:
    """Model inputs: the one-hot block is replaced by one derived column at the end."""
    kept = [c for c in features if not c.startswith(ONE_HOT_PREFIX)]
    return kept + ([ONE_HOT_COLUMN] if len(kept) < len(features) else [])


def retained(df: DataFrame) -> DataFrame:
    """All rows of training folds, only the first record of a stay elsewhere."""
    return df.filter(
        (F.col("general_strat_fold") < TRAIN_FOLDS) | (F.col("general_ecg_no_within_stay") == 0)
    )


def derived_inputs(features: list[str]) -> dict[str, Column]:
    """Model inputs as expressions over the raw feature columns."""
    hot = [c for c in features if c.startswith(ONE_HOT_PREFIX)]
    out: dict[str, Column] = {}
    for name in input_columns(features):
        if name == ONE_HOT_COLUMN and hot:
            out[name] = hot_index(F.array(*[F.col(c) for c in hot])).cast("double")
        elif name == ACUITY:
            out[name] = F.col(name).cast("double") - F.lit(1.0)
        else:
            out[name] = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return out


def fold_split(fold: Column) -> Column:
    return (
        F.when(fold < TRAIN_FOLDS, "train")
        .when(fold == VALIDATION_FOLD, "val")
        .when(fold == TEST_FOLD, "test")
    )


def long_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, value, is_train) per retained row and input."""
    named = derived_inputs(features)
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), e.alias("value")) for n, e in named.items()])
    return (
        retained(df)
        .select((F.col("general_strat_fold") < TRAIN_FOLDS).alias("is_train"), F.explode(pairs).alias("p"))
        .select("is_train", "p.column", "p.value")
    )


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, value, rows, train rows): the only shuffle of the fit."""
    return (
        long_inputs(df, features)
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.count_if("is_train").alias("n_train"))
    )


def column_stats(df: DataFrame, features: list[str], train_only_sets: bool = False) -> DataFrame:
    """Per column: exact train median, distinct-value set below the limit, NULL flags.

    Everything comes from the collapsed value counts. The median is found by running
    counts over value ranges, so no column is sorted in one task.
    """
    from ..functions.ranks import running_sums

    counted = value_counts(df, features)
    seen = F.col("n_train") if train_only_sets else F.col("n")
    sets = counted.filter(F.col("value").isNotNull() & (seen > 0)).groupBy("column").agg(
        F.count("*").alias("distinct_values")
    )
    small = sets.filter(F.col("distinct_values") < CARDINALITY_LIMIT)
    values = (
        counted.filter(F.col("value").isNotNull() & (seen > 0))
        .join(F.broadcast(small.select("column")), "column", "left_semi")
        .groupBy("column")
        .agg(F.array_sort(F.collect_set("value")).alias("value_set"))
    )
    gaps = counted.groupBy("column").agg(
        F.bool_or(F.col("value").isNull()).alias("missing_all"),
        F.bool_or(F.col("value").isNull() & (F.col("n_train") > 0)).alias("missing_train"),
    )
    train = counted.filter(F.col("value").isNotNull() & (F.col("n_train") > 0))
    ranked = running_sums(train, ["column"], "value", ["n_train"])
    end = F.col("n_train_before") + F.col("n_train")
    at = (F.col("n_train_all") - 1) / F.lit(2.0)
    holds = lambda k: (F.col("n_train_before") <= k) & (k < end)
    medians = ranked.groupBy("column").agg(
        (
            (F.max(F.when(holds(F.floor(at)), F.col("value"))) + F.max(F.when(holds(F.ceil(at)), F.col("value"))))
            / F.lit(2.0)
        ).alias("median")
    )
    return (
        gaps.join(medians, "column", "left")
        .join(sets, "column", "left")
        .join(values, "column", "left")
        .select(
            "column",
            F.coalesce("median", F.lit(0.0)).alias("median"),
            F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
            F.when(
                F.coalesce("distinct_values", F.lit(0)) < CARDINALITY_LIMIT,
                F.coalesce("value_set", F.array().cast("array<double>")),
            ).alias("value_set"),
            "missing_all",
            "missing_train",
        )
    )


def fit_table(
    df: DataFrame,
    expected: dict[str, int] | None = None,
    masks: bool = True,
    categorical_masks: bool = False,
    train_only_sets: bool = False,
) -> TableSpec:
    """Fit medians, categories and masks; one statistics row per column is collected."""
    roles = column_roles(df.columns, expected)
    inputs = input_columns(roles.features)
    rows = {r["column"]: r for r in column_stats(df, roles.features, train_only_sets).collect()}
    if not rows:
        raise checks.AuditError("no rows in the training folds")
    categories: dict[str, list[float]] = {}
    for name in inputs:
        found = rows[name]["value_set"]
        if found is None:
            continue
        found = set(found) | ({rows[name]["median"]} if rows[name]["missing_all"] else set())
        if len(found) < CARDINALITY_LIMIT and not name.startswith("labvalues_"):
            categories[name] = sorted(found)
    mask_names = [f"{n}_nan" for n in inputs if masks and rows[n]["missing_train"]]
    if categorical_masks:
        categories.update({m: [0.0, 1.0] for m in mask_names})
    return TableSpec(
        features=roles.features,
        inputs=inputs,
        medians={n: rows[n]["median"] for n in inputs},
        categories=categories,
        masks=mask_names,
        continuous=[n for n in inputs if n not in categories] + ([] if categorical_masks else mask_names),
        diagnoses=roles.diagnoses,
        deterioration=roles.deterioration,
    )


def transform_table(df: DataFrame, spec: TableSpec, task: str = "diagnoses") -> DataFrame:
    """One projection: ids, fold, continuous vector, category codes, label vector."""
    raw = derived_inputs(spec.features)
    filled: dict[str, Column] = {
        n: F.coalesce(raw[n], F.lit(float(spec.medians[n]))) for n in spec.inputs
    }
    for mask in spec.masks:
        filled[mask] = raw[mask.removesuffix("_nan")].isNull().cast("double")
    labels = spec.diagnoses if task == "diagnoses" else spec.deterioration
    label_cols = [F.col(c).cast("float") for c in labels]
    if task == "deterioration":
        label_cols = [F.nullif(c, F.lit(float(MISSING_LABEL)).cast("float")) for c in label_cols]
    empty = F.array().cast("array<float>")
    return retained(df).select(
        F.col("general_study_id").cast("bigint").alias("study_id"),
        F.col("general_subject_id").cast("bigint").alias("subject_id"),
        F.col("general_strat_fold").cast("int").alias("fold"),
        F.array(*[filled[n].cast("float") for n in spec.continuous]).alias("cont") if spec.continuous else empty.alias("cont"),
        (
            F.array(*[code_of(filled[n], c, n) for n, c in spec.categories.items()])
            if spec.categories
            else F.array().cast("array<int>")
        ).alias("cat"),
        (F.array(*label_cols) if label_cols else empty).alias("labels"),
    )


def release_totals(df: DataFrame) -> DataFrame:
    """Rows, distinct patients, visits, zero-label rows and folds of a wide release."""
    roles = column_roles(df.columns)
    positives = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in roles.diagnoses), F.lit(0))
    visit = F.col("general_ed_stay_id") if "general_ed_stay_id" in df.columns else F.lit(None)
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("general_subject_id").alias("patients"),
        F.countDistinct(visit).alias("visits"),
        F.count_if(positives == 0).alias("zero_label_rows"),
        F.countDistinct("general_strat_fold").alias("folds"),
    )


def study_ids(df: DataFrame, column: str = "general_study_id") -> DataFrame:
    """Distinct study ids; text such as ``123.0`` is accepted."""
    value = F.col(column).cast("string").try_cast("double").cast("bigint")
    return df.select(value.alias("study_id")).filter(F.col("study_id").isNotNull()).distinct()
