"""Stay cohort: unit-transfer rule, single stay per admission, age, length of stay, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import age_years, hours_between
from . import checks

MIN_AGE = 18.0
SPLITS = ("train", "val", "test")


def without_transfer(stays: DataFrame) -> DataFrame:
    """Stays whose first and last ward and first and last unit agree."""
    return stays.filter(
        (F.col("first_ward") == F.col("last_ward")) & (F.col("first_unit") == F.col("last_unit"))
    )


def with_admission(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    return stays.join(admissions, ["subject_id", "hadm_id"], "inner")


def with_patient(stays: DataFrame, patients: DataFrame) -> DataFrame:
    return stays.join(patients, "subject_id", "inner")


def single_stay_admissions(stays: DataFrame) -> DataFrame:
    """Keep admissions with exactly one surviving stay.

    A group aggregate instead of a window: an admission with many stays is reduced on
    the map side, and the surviving row is carried along by ``first``.
    """
    columns = [c for c in stays.columns if c != "hadm_id"]
    grouped = stays.groupBy("hadm_id").agg(
        F.count("stay_id").alias("_n"), *[F.first(c).alias(c) for c in columns]
    )
    return grouped.filter(F.col("_n") == 1).select(*stays.columns)


def with_age(stays: DataFrame, minimum: float = MIN_AGE) -> DataFrame:
    return stays.withColumn("age", age_years("intime", "born")).filter(F.col("age") >= minimum)


def with_los(stays: DataFrame, at_least: float | None = None) -> DataFrame:
    out = stays.withColumn("los_hours", hours_between("outtime", "intime"))
    return out if at_least is None else out.filter(F.col("los_hours") >= at_least)


def cohort_output(stays: DataFrame) -> DataFrame:
    """Published columns; the last unit is published as the unit."""
    return stays.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        F.col("last_unit").alias("first_unit"),
        "dbsource",
        "intime",
        "outtime",
        "los_hours",
        "age",
        "gender",
        "ethnicity",
    )


def benchmark_stays(stays: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    joined = with_patient(with_admission(without_transfer(stays), admissions), patients)
    return cohort_output(with_los(with_age(single_stay_admissions(joined))))


def subject_list(lines: DataFrame) -> DataFrame:
    """Subjects of a headerless ``subject,flag`` list whose flag is 1."""
    return lines.filter(F.col("flag") == 1).select("subject_id").distinct()


def split_overlap(test: DataFrame, val: DataFrame) -> DataFrame:
    shared = test.join(val, "subject_id", "left_semi")
    return shared.agg(F.count("*").alias("violations")).select(
        F.lit("subject in both test and val list").alias("check"), "violations"
    )


def assign_partitions(stays: DataFrame, test: DataFrame, val: DataFrame, strict: bool = True) -> DataFrame:
    """Attach train / val / test by two subject lists; overlapping lists are an error."""
    if strict:
        checks.enforce(split_overlap(test, val))
    lists = test.select("subject_id", F.lit("test").alias("_list")).unionByName(
        val.select("subject_id", F.lit("val").alias("_list"))
    )
    named = lists.groupBy("subject_id").agg(F.min("_list").alias("_list"))
    return (
        stays.join(named, "subject_id", "left")
        .withColumn("partition", F.coalesce("_list", F.lit("train")))
        .drop("_list")
    )


def unit_codes(stays: DataFrame, unit: str = "first_unit") -> DataFrame:
    """Alphabetical integer code per care unit; the window runs over the distinct units."""
    units = stays.filter(F.col(unit).isNotNull()).select(unit).distinct()
    return units.withColumn(
        "unit_code", (F.row_number().over(Window.orderBy(unit)) - 1).cast("int")
    )


def one_subject_per_stay(stays: DataFrame) -> DataFrame:
    return checks.many_values_count(stays, "stay_id", "subject_id", "stay maps to several subjects")


def first_stays(stays: DataFrame, n: int) -> DataFrame:
    """The first ``n`` stays by id."""
    return stays.orderBy("stay_id").limit(n)


def window_population(stays: DataFrame, offsets: DataFrame, duration: float, require_note: bool) -> DataFrame:
    """Stays that last ``duration`` hours, with the flag "a note exists inside the window"."""
    kept = stays.filter(F.col("los_hours") >= duration).join(offsets, "stay_id", "left")
    kept = kept.withColumn(
        "has_note", F.coalesce(F.col("first_note_hours") <= duration, F.lit(False))
    )
    return kept.filter("has_note") if require_note else kept


def with_positive_label(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return items.join(labels.select(key), key, "left_semi")


def split_counts(items: DataFrame, positives: DataFrame, key: str = "stay_id") -> DataFrame:
    """Rows per split, and positives per (split, label), from one grouping-sets pass."""
    sizes = items.groupBy("partition").agg(F.count("*").alias("n")).select(
        "partition", F.lit("(rows)").alias("label"), "n"
    )
    marked = positives.join(items.select(key, "partition"), key)
    part, label = F.col("partition"), F.col("label")
    pos = marked.groupingSets([[part, label], [label]], part, label).agg(F.count("*").alias("n"))
    return sizes.unionByName(pos.withColumn("partition", F.coalesce("partition", F.lit("(all)"))))


def sizing_grid(
    stays: DataFrame, offsets: DataFrame, groups: DataFrame, durations: list[float], max_groups: int
) -> DataFrame:
    """Cohort size, label groups and labels per stay for each candidate window.

    ``stays`` has one row per stay with ``hadm_id``; ``groups`` one row per coded
    diagnosis (hadm_id, grp, source_row). Every stay is tagged with the windows it
    qualifies for by a literal array, so no cross join is needed.
    """
    grid = F.array(*[F.lit(float(d)) for d in durations])
    long = (
        stays.join(offsets, "stay_id", "left")
        .withColumn("duration", F.explode(grid))
        .filter(F.col("los_hours") >= F.col("duration"))
        .withColumn(
            "noted", F.coalesce(F.col("first_note_hours") <= F.col("duration"), F.lit(False))
        )
    )
    sizes = long.groupBy("duration").agg(
        F.count("*").alias("long_enough"), F.count_if("noted").alias("with_note")
    )
    pool = long.filter("noted").select("duration", "stay_id", "hadm_id")
    hadms = pool.select("duration", "hadm_id").distinct()
    scoped = groups.join(hadms, "hadm_id")
    freq = scoped.groupBy("duration", "grp").agg(
        F.count("*").alias("_n"), F.min("source_row").alias("_first")
    )
    # One row per (window, group): a dimension of at most a few thousand groups.
    order = Window.partitionBy("duration").orderBy(F.desc("_n"), F.asc("_first"), F.asc("grp"))
    keep = freq.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_groups)
    n_groups = keep.groupBy("duration").agg(F.count("*").alias("label_groups"))
    per_hadm = (
        scoped.join(keep.select("duration", "grp"), ["duration", "grp"], "left_semi")
        .select("duration", "hadm_id", "grp")
        .distinct()
        .groupBy("duration", "hadm_id")
        .agg(F.count("*").alias("_labels"))
    )
    final = (
        pool.join(per_hadm, ["duration", "hadm_id"])
        .groupBy("duration")
        .agg(F.count("*").alias("final_cohort"), F.avg("_labels").alias("labels_per_stay"))
    )
    out = sizes.join(n_groups, "duration", "left").join(final, "duration", "left")
    return out.select(
        "duration",
        "long_enough",
        "with_note",
        F.coalesce("final_cohort", F.lit(0)).alias("final_cohort"),
        F.coalesce("label_groups", F.lit(0)).alias("label_groups"),
        "labels_per_stay",
        (F.coalesce("final_cohort", F.lit(0)) * F.col("duration").cast("int"))
        .cast("bigint")
        .alias("step_rows"),
    )
