"""Assembling the keyed split table and attaching columns to an existing one."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.ranks import row_ranks
from ..session import cut_lineage
from . import checks, cohort, notes

SPLITS = cohort.SPLITS


def attach_split(items: DataFrame, stays: DataFrame) -> DataFrame:
    """Left join of subject, unit and split onto the items."""
    keys = stays.select("stay_id", "subject_id", "first_unit", "partition")
    return items.join(keys, "stay_id", "left")


def split_findings(cohort_rows: DataFrame) -> DataFrame:
    """Items without a split and non-positive subject ids."""
    return checks.count_findings(
        cohort_rows,
        {
            "stay without split": F.col("partition").isNull(),
            "subject id not positive": F.col("subject_id") <= 0,
        },
    )


def subject_leaks(items: DataFrame, subject: str = "subject_id", split: str = "partition") -> DataFrame:
    """Subjects shared by each pair of splits, pairs without overlap left out.

    The set of splits of a subject is at most three values, so pairs come from a bit
    mask over literals instead of a self join.
    """
    bit = F.when(F.col(split) == "train", 1).when(F.col(split) == "val", 2).otherwise(4)
    masks = items.groupBy(subject).agg(F.bit_or(bit).alias("m"))
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("pair"), F.lit(m).alias("need"))
            for name, m in (("train/val", 3), ("train/test", 5), ("val/test", 6))
        ]
    )
    return (
        masks.withColumn("p", F.explode(pairs))
        .filter(F.col("m").bitwiseAND(F.col("p.need")) == F.col("p.need"))
        .groupBy(F.col("p.pair").alias("pair"))
        .agg(F.count("*").alias("subjects"))
    )


def assemble(
    population: DataFrame, note_tokens: DataFrame, stays: DataFrame, frames: DataFrame | None, note_length: int
) -> DataFrame:
    """Population + notes + subject + unit code + availability (+ frames), keyed by stay."""
    rows = attach_split(notes.attach_notes(population, note_tokens, note_length), stays)
    coded = rows.join(F.broadcast(cohort.unit_codes(stays)), "first_unit", "left")
    return coded if frames is None else coded.join(frames, "stay_id")


def write_split_table(rows: DataFrame, path: str, strict: bool = True) -> None:
    """Write by split after the completeness and leak checks; an existing table is refused."""
    if strict:
        checks.enforce(split_findings(rows))
        if not subject_leaks(rows).isEmpty():
            raise checks.AuditError("subject leakage across splits")
    checks.write_new(rows, path, ["partition"])


def read_split(spark, path: str, *splits: str) -> DataFrame:
    """Rows of the named splits; the filter prunes partition folders."""
    table = spark.read.parquet(path)
    return table.filter(F.col("partition").isin(list(splits))) if splits else table


def attach_findings(existing: DataFrame, addition: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Keys missing on either side, labels that differ, existing columns that differ."""
    shared = [c for c in columns if c in existing.columns]
    a = existing.select("stay_id", F.col(label).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in shared])
    b = addition.select("stay_id", F.col(label).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in shared])
    both = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), "stay_id", "full_outer")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    rules = {
        "key only in artifact": F.col("_r").isNull(),
        "key only in addition": F.col("_l").isNull(),
        "labels differ": matched & ~F.col("_a").eqNullSafe(F.col("_b")),
    }
    for c in shared:
        rules[f"column {c} differs"] = matched & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return checks.count_findings(both, rules)


def attach_columns(existing: DataFrame, addition: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """A new version of the artifact with ``columns`` added; labels must agree per key."""
    checks.enforce(attach_findings(existing, addition, label, columns))
    new = [c for c in columns if c not in existing.columns]
    return existing.join(addition.select("stay_id", *new), "stay_id") if new else existing


def group_split(
    groups: DataFrame,
    positives: DataFrame,
    seed: int,
    shares: tuple[float, float, float] = (0.6, 0.2, 0.2),
    key: str = "group_id",
) -> DataFrame:
    """Deterministic stratified split over groups; every group lands in one split.

    A group's stratum is its rarest label. Inside a stratum, groups are put in the order
    of a seeded hash and cut at the cumulative shares. The library procedure this stands
    for assigns groups one at a time; here the guarantees are the same, not the draws.
    """
    counts = positives.groupBy("label").agg(F.count("*").alias("_n"))
    rarest = (
        positives.join(F.broadcast(counts), "label")
        .groupBy(key)
        .agg(F.min_by("label", F.struct("_n", "label")).alias("stratum"))
    )
    rows = groups.select(key).join(rarest, key, "left").withColumn(
        "stratum", F.coalesce("stratum", F.lit("(none)"))
    )
    rows = rows.withColumn("_u", uniform(seed, "split", key))
    ranked = row_ranks(rows, ["stratum"], "_u", key, "_rank")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("_size"))
    at = (F.col("_rank") - F.lit(0.5)) / F.col("_size")
    name = (
        F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "val").otherwise("test")
    )
    return ranked.join(F.broadcast(sizes), "stratum").select(key, "stratum", name.alias("partition"))


def split_manifest(items: DataFrame, groups: DataFrame, item: str, key: str = "group_id") -> DataFrame:
    return items.select(item, key).join(groups.select(key, "partition"), key)


def serpentine_folds(groups: DataFrame, key: str, size: str, folds: int) -> DataFrame:
    """Whole groups to folds of near-equal size: sizes descending, folds back and forth."""
    ranked = row_ranks(groups, [], size, key, "_rank", descending=True)
    lap = F.floor((F.col("_rank") - 1) / F.lit(folds))
    slot = ((F.col("_rank") - 1) % folds).cast("int")
    fold = F.when(lap % 2 == 0, slot).otherwise(F.lit(folds - 1) - slot)
    return ranked.select(key, size, fold.cast("int").alias("fold"))


@dataclass
class SizeClass:
    """All groups of one size: the place in the class from which a cycle of folds holds, for each."""

    size: int
    cycles: list[tuple[int, list[int]]]


def place_classes(counts: list[tuple[int, int]], folds: int) -> tuple[list[SizeClass], list[int]]:
    """(size, number of groups), sizes descending -> how the groups of each class are dealt, and the
    loads of the folds.

    The rule is the sequential one: the next group goes to the fold with the least load, the first
    of equal ones. With load = q * size + rest, the groups of a class go to the folds in the order of
    (level, rest, fold), where a fold takes part from level q on. So a class needs a cycle for each
    set of folds that take part, and not a step for each group.
    """
    loads = [0] * folds
    out = []
    for size, count in counts:
        starts = sorted((load // size, load % size, f) for f, load in enumerate(loads))
        cycles, at, given = [], 0, [0] * folds
        levels = sorted({q for q, _, _ in starts})
        for level, after in zip(levels, [*levels[1:], None]):
            cycle = [f for _, f in sorted((rest, f) for q, rest, f in starts if q <= level)]
            room = count - at if after is None else min(count - at, (after - level) * len(cycle))
            if room <= 0:
                break
            cycles.append((at, cycle))
            for k, f in enumerate(cycle):
                given[f] += room // len(cycle) + (k < room % len(cycle))
            at += room
        loads = [load + size * n for load, n in zip(loads, given)]
        out.append(SizeClass(size, cycles))
    return out, loads


def balanced_folds(groups: DataFrame, key: str, size: str, folds: int) -> DataFrame:
    """Whole groups to folds, longest first: sizes descending, equal sizes by key, each to the fold
    with the least load so far. ``groups(key, size)`` -> key, size, fold.

    The driver sees the distinct sizes and how many groups have each, not the groups; a group's place
    in its class is an exact distributed rank, so the result does not depend on partitions.
    """
    spark = groups.sparkSession
    counts = groups.groupBy(size).agg(F.count("*").alias("n")).collect()
    dealt, _ = place_classes(sorted(((r[size], r["n"]) for r in counts), reverse=True), folds)
    plan = spark.createDataFrame(
        [(c.size, [(a, cycle) for a, cycle in c.cycles]) for c in dealt], "_class long, _cycles array<struct<at: long, folds: array<int>>>"
    )
    ranked = row_ranks(groups.select(key, size), [size], key, key, "_place")
    place = F.col("_place") - 1
    mine = F.element_at(F.filter("_cycles", lambda c: c["at"] <= place), -1)
    rows = ranked.join(plan, F.col(size) == F.col("_class")).withColumn("_c", mine)
    fold = F.element_at(F.col("_c.folds"), ((place - F.col("_c.at")) % F.size("_c.folds") + 1).cast("int"))
    return rows.select(key, size, fold.alias("fold"))


#: Steps of this size through [0, 1) spread any run of consecutive places evenly.
GOLDEN = 0.6180339887498949
SETS = 1 << 20


def quotas(wishes: list[float], count: int) -> list[int]:
    """``count`` places among splits in proportion to what each still wants, by largest remainders,
    the first split of equal ones."""
    wishes = [max(0.0, w) for w in wishes]
    total = sum(wishes)
    exact = [count * w / total for w in wishes] if total > 0 else [count / len(wishes)] * len(wishes)
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: count - sum(out)]:
        out[i] += 1
    return out


def iterative_split(
    groups: DataFrame,
    positives: DataFrame,
    seed: int,
    shares: tuple[float, ...] = (0.6, 0.2, 0.2),
    names: tuple[str, ...] = ("train", "val", "test"),
    key: str = "group_id",
) -> DataFrame:
    """Iterative stratification over groups: ``groups(key)``, ``positives(key, label)`` ->
    key, partition.

    Round by round the label with the fewest positive groups left, the first of equal ones, deals all
    of them out; every split still wants its share of the label less what earlier rounds gave it.
    Inside a round groups are ordered by their set of labels, then by a seeded hash, and dealt along a
    golden-section sequence, so that each set of labels is spread over the splits like the whole. At
    last the groups without a label even out the number of groups. A round is a few jobs over the
    groups of its label, and there are as many as labels; the driver sees counts only.
    """
    sets = positives.select(key, "label").distinct().groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    left = groups.select(key).distinct().join(sets, key, "left")
    left = left.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    # Sets of labels in the order of a hash, and groups of one set in the order of another.
    by = F.floor(uniform(seed, "set", F.concat_ws("|", "labels")) * F.lit(float(SETS))) + uniform(seed, "split", key)
    left = cut_lineage(left.withColumn("_by", by))
    totals = {r["label"]: r["n"] for r in left.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = left.count()
    given = {label: [0] * len(shares) for label in [*totals, None]}
    dealt: list[DataFrame] = []
    rest = dict(totals)
    while True:
        open_ = [(n, label) for label, n in rest.items() if n]
        label = min(open_)[1] if open_ else None
        mine = left.filter(F.array_contains("labels", label)) if label is not None else left
        wanted = size if label is None else totals[label]
        count = rest[label] if label is not None else size - sum(given[None])
        parts = quotas([s * wanted - g for s, g in zip(shares, given[label])], count)
        ordered = row_ranks(mine, [], "_by", key, "_place")
        at = F.col("_place") * F.lit(GOLDEN)
        spread = row_ranks(ordered.withColumn("_v", at - F.floor(at)), [], "_v", key, "_turn")
        name, stop = F.lit(names[-1]), 0
        bounds = list(itertools.accumulate(parts))
        for n, stop in reversed(list(zip(names[:-1], bounds[:-1]))):
            name = F.when(F.col("_turn") <= stop, F.lit(n)).otherwise(name)
        now = cut_lineage(spread.select(key, "labels", name.alias("partition")))
        dealt.append(now.select(key, "partition"))
        given[None] = [a + b for a, b in zip(given[None], parts)]
        if label is None:
            return checks.union_all(dealt)
        cells = now.select("partition", F.explode("labels").alias("label")).groupBy("label", "partition").agg(F.count("*").alias("n"))
        for r in cells.collect():
            given[r["label"]][names.index(r["partition"])] += r["n"]
            rest[r["label"]] -= r["n"]
        left = cut_lineage(left.filter(~F.array_contains("labels", label)))



def share_deviation(
    split: DataFrame,
    positives: DataFrame,
    shares: tuple[float, ...] = (0.6, 0.2, 0.2),
    names: tuple[str, ...] = ("train", "val", "test"),
    key: str = "group_id",
) -> DataFrame:
    """label, partition, deviation: how far a split's part of each label's groups is from its share."""
    counts = positives.select(key, "label").distinct().join(split.select(key, "partition"), key)
    cells = counts.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(F.col("partition") == n).alias(f"_{n}") for n in names])
    rows = [F.struct(F.lit(n).alias("partition"), F.abs(F.col(f"_{n}") / F.col("n") - F.lit(s)).alias("deviation")) for n, s in zip(names, shares)]
    return cells.select("label", F.explode(F.array(*rows)).alias("c")).select("label", "c.partition", "c.deviation")
