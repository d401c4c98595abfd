"""Coded diagnoses, code groups and multi-hot label tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..session import cut_lineage
from . import checks


def group_dimension(definitions: DataFrame) -> DataFrame:
    """Explode (grp, group_id, use_flag, codes) to one row per code."""
    return definitions.select("grp", "group_id", "use_flag", F.explode("codes").alias("code"))


def group_dimension_findings(definitions: DataFrame) -> DataFrame:
    """A code may belong to one group only; a group id may be used once."""
    codes = group_dimension(definitions)
    return checks.many_values_count(codes, "code", "grp", "code in two groups").unionByName(
        checks.many_values_count(definitions, "group_id", "grp", "group id used twice")
    )


def known_codes(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows whose code is in the dictionary, with its title."""
    return diagnoses.join(dictionary, "code", "inner")


def to_stays(diagnoses: DataFrame, stays: DataFrame) -> DataFrame:
    """Expand admission codes to the stays of the admission."""
    keys = stays.select("subject_id", "hadm_id", "stay_id").dropDuplicates()
    return diagnoses.join(keys, ["subject_id", "hadm_id"], "inner")


def attach_groups(diagnoses: DataFrame, groups: DataFrame) -> DataFrame:
    """Code to group and flag; NULL where the code is in no group."""
    return diagnoses.join(groups.select("code", "grp", "use_flag"), "code", "left")


def coded_diagnoses(
    diagnoses: DataFrame, dictionary: DataFrame, stays: DataFrame, groups: DataFrame
) -> DataFrame:
    """Stay-level coded diagnoses in (stay, sequence) order."""
    out = attach_groups(to_stays(known_codes(diagnoses, dictionary), stays), groups)
    return out.orderBy("stay_id", "seq")


def stay_groups(coded: DataFrame, key: str = "stay_id") -> DataFrame:
    """Distinct (stay, group): the positives table behind every multi-hot matrix."""
    return coded.filter(F.col("grp").isNotNull()).select(key, F.col("grp").alias("label")).distinct()


def flagged_names(definitions: DataFrame) -> DataFrame:
    """Label dimension of the flagged groups in alphabetical order."""
    names = definitions.filter("use_flag").select(F.col("grp").alias("label")).distinct()
    return names.withColumn("ord", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def flagged_labels(stays: DataFrame, coded: DataFrame, definitions: DataFrame) -> DataFrame:
    """Positives over the flagged groups, limited to the given stays."""
    return (
        stay_groups(coded)
        .join(flagged_names(definitions), "label")
        .join(stays.select("stay_id"), "stay_id", "left_semi")
    )


def frequent_names(
    coded: DataFrame,
    definitions: DataFrame,
    stays: DataFrame | None = None,
    minimum: int = 30,
    expected: int | None = None,
) -> DataFrame:
    """Groups present in at least ``minimum`` distinct stays, ordered by (group id, name)."""
    pos = stay_groups(coded)
    if stays is not None:
        pos = pos.join(stays.select("stay_id"), "stay_id", "left_semi")
    counted = pos.groupBy("label").agg(F.count("*").alias("episodes"))
    ids = definitions.select(F.col("grp").alias("label"), "group_id").distinct()
    names = counted.filter(F.col("episodes") >= minimum).join(ids, "label")
    names = names.withColumn(
        "ord", (F.row_number().over(Window.orderBy("group_id", "label")) - 1).cast("int")
    )
    if expected is not None:
        found = names.count()
        if found != expected:
            raise checks.AuditError(f"rule selected {found} labels, expected {expected}")
    return names


def frequent_labels(
    stays: DataFrame,
    coded: DataFrame,
    definitions: DataFrame,
    minimum: int = 30,
    expected: int | None = None,
    count_all: bool = False,
) -> DataFrame:
    """Positives over the frequent groups; ``count_all`` counts stays outside ``stays`` too."""
    names = frequent_names(coded, definitions, None if count_all else stays, minimum, expected)
    return (
        stay_groups(coded)
        .join(names.select("label", "ord"), "label")
        .join(stays.select("stay_id"), "stay_id", "left_semi")
    )


def top_groups(diagnoses: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent groups by code rows, ties by first appearance."""
    freq = diagnoses.groupBy("grp").agg(
        F.count("*").alias("n"), F.min("source_row").alias("first_row")
    )
    kept = freq.orderBy(F.desc("n"), F.asc("first_row"), F.asc("grp")).limit(n)
    return kept.withColumn("ord", (F.row_number().over(Window.orderBy("grp")) - 1).cast("int"))


def window_labels(population: DataFrame, diagnoses: DataFrame, n: int) -> DataFrame:
    """(stay, group) positives of a fixed-window population over its top groups."""
    scoped = diagnoses.join(population.select("hadm_id"), "hadm_id", "left_semi")
    keep = top_groups(scoped, n).select("grp", "ord")
    pairs = scoped.join(keep, "grp").select("hadm_id", "grp", "ord").distinct()
    return population.select("stay_id", "hadm_id").join(pairs, "hadm_id").select(
        "stay_id", F.col("grp").alias("label"), "ord"
    )


def label_matrix(items: DataFrame, positives: DataFrame, names: list[str], key: str = "stay_id") -> DataFrame:
    """One row per item, one 0/1 column per label name (a bounded label list)."""
    wide = positives.groupBy(key).pivot("label", names).agg(F.max(F.lit(1)))
    return items.select(key).join(wide, key, "left").na.fill(0)


def positive_counts(positives: DataFrame) -> DataFrame:
    return positives.groupBy("label").agg(F.count("*").alias("positives"))


def label_metadata(names: DataFrame, task: str) -> DataFrame:
    """Ordered label names with the task they belong to, stored next to the data."""
    return names.select(F.lit(task).alias("task"), F.col("ord").cast("int").alias("ord"), "label")


def prevalence_top(positives: DataFrame, n: int = 50) -> DataFrame:
    counted = positive_counts(positives)
    return counted.orderBy(F.desc("positives"), F.asc("label")).limit(n)


def cardinality_histogram(items: DataFrame, positives: DataFrame, key: str = "stay_id") -> DataFrame:
    per = positives.groupBy(key).agg(F.count("*").alias("labels"))
    return (
        items.select(key)
        .join(per, key, "left")
        .groupBy(F.coalesce("labels", F.lit(0)).cast("bigint").alias("labels"))
        .agg(F.count("*").alias("items"))
    )


# Labels of a task's dense count table, and label pairs that are counted at once beyond it.
DENSE_LABELS, PAIRS_AT_ONCE = 2048, 1 << 21


def _sparse_counts(codes: np.ndarray, lengths: list[int], labels: int):
    """(left, right, count) arrays of all pairs of each item's codes, some pairs at a time."""
    lefts, rights, held = [], [], 0
    at = 0
    for n in lengths:
        own, at = codes[at : at + n], at + n
        for i in range(0, n, max(1, PAIRS_AT_ONCE // max(1, n))):
            part = own[i : i + max(1, PAIRS_AT_ONCE // max(1, n))]
            lefts.append(np.repeat(part, n))
            rights.append(np.tile(own, len(part)))
            held += len(part) * n
            if held >= PAIRS_AT_ONCE:
                yield _counted(lefts, rights, labels)
                lefts, rights, held = [], [], 0
    if held:
        yield _counted(lefts, rights, labels)


def _counted(lefts: list, rights: list, labels: int):
    pairs, n = np.unique(np.concatenate(lefts) * labels + np.concatenate(rights), return_counts=True)
    return pairs // labels, pairs % labels, n


def _pair_counts(positives: DataFrame, key: str) -> DataFrame:
    """(left_label, right_label, both) from one pass over the positives.

    An item's labels arrive as one array. Each task adds its items to a label Gram matrix
    and emits the non-zero cells once, so the shuffle carries cells of the label
    dimension, not the pairs of an item. The diagonal holds the label counts. Where a task
    meets more labels than the matrix may have, it goes on with sparse counts.
    """
    sets = positives.groupBy(key).agg(F.collect_set("label").alias("labels")).select("labels")

    def kernel(batches):
        index: dict[str, int] = {}
        gram = np.zeros((64, 64), dtype=np.int64)

        def frame(left, right, both):
            names = np.array(list(index), dtype=object)
            return pd.DataFrame({"left_label": names[left], "right_label": names[right], "both": both})

        for batch in batches:
            lengths = [len(x) for x in batch["labels"]]
            if not sum(lengths):
                continue
            flat = np.concatenate([np.asarray(x, dtype=object) for x in batch["labels"]])
            found, names = pd.factorize(flat)
            codes = np.array([index.setdefault(v, len(index)) for v in names], dtype=np.int64)[found]
            if len(index) > DENSE_LABELS:
                for cells in _sparse_counts(codes, lengths, len(index)):
                    yield frame(*cells)
                continue
            if len(index) > len(gram):
                size = min(DENSE_LABELS, 2 * len(index))
                gram = np.pad(gram, (0, size - len(gram)))
            hot = np.zeros((len(batch), len(gram)), dtype=np.float32)
            hot[np.repeat(np.arange(len(batch)), lengths), codes] = 1
            gram += (hot.T @ hot).astype(np.int64)
        left, right = np.nonzero(gram)
        yield frame(left, right, gram[left, right])

    cells = sets.mapInPandas(kernel, "left_label string, right_label string, both long")
    return cells.groupBy("left_label", "right_label").agg(F.sum("both").alias("both"))


def cooccurrence(positives: DataFrame, top: int = 25, key: str = "stay_id") -> DataFrame:
    """Cosine of label co-occurrence among the ``top`` labels."""
    cells = cut_lineage(_pair_counts(positives, key))
    names = (
        cells.filter(F.col("left_label") == F.col("right_label"))
        .orderBy(F.desc("both"), "left_label")
        .limit(top)
    )
    a = names.select("left_label", F.col("both").alias("_n1"))
    b = names.select(F.col("left_label").alias("right_label"), F.col("both").alias("_n2"))
    return (
        cells.join(F.broadcast(a), "left_label")
        .join(F.broadcast(b), "right_label")
        .select(
            "left_label",
            "right_label",
            "both",
            (F.col("both") / F.greatest(F.sqrt(F.col("_n1") * F.col("_n2")), F.lit(1.0))).alias("cosine"),
        )
    )


def cooccurrence_density(positives: DataFrame, names: DataFrame, key: str = "stay_id") -> DataFrame:
    """Share of ordered label pairs that occur together at least once."""
    cells = _pair_counts(positives, key)
    labels = names.agg(F.count("*").alias("c"))
    return with_scalars(cells.agg(F.count("*").alias("pairs")), labels).select(
        "pairs", (F.col("pairs") / (F.col("c") * F.col("c"))).alias("density")
    )


def split_coverage(items: DataFrame, positives: DataFrame, key: str = "stay_id") -> DataFrame:
    """Number of labels with at least one positive in each split."""
    marked = positives.join(items.select(key, "partition"), key)
    return (
        marked.select("partition", "label").distinct().groupBy("partition").agg(F.count("*").alias("labels"))
    )


def absent_labels(items: DataFrame, positives: DataFrame, names: DataFrame, splits: list[str], key: str) -> DataFrame:
    """Positives per (split, label) including zeros: a zero is a split that lacks a label."""
    grid = names.select("label").withColumn(
        "partition", F.explode(F.array(*[F.lit(s) for s in splits]))
    )
    counted = (
        positives.join(items.select(key, "partition"), key)
        .groupBy("partition", "label")
        .agg(F.count("*").alias("n"))
    )
    return grid.join(counted, ["partition", "label"], "left").select(
        "partition", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def frequency_ranks(positives: DataFrame, names: DataFrame) -> DataFrame:
    """Label frequency rank on the given (train) positives, ties by column order."""
    counted = names.join(positive_counts(positives), "label", "left").select(
        "label", "ord", F.coalesce("positives", F.lit(0)).alias("positives")
    )
    order = Window.orderBy(F.desc("positives"), F.asc("ord"))
    return counted.withColumn("freq_rank", F.row_number().over(order).cast("bigint"))
