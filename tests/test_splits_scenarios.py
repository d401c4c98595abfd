"""Split assembly, attach rules, group splits and scenario invariants."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from poolweave.operators import checks, labels, scenario, splits
from poolweave.session import scratch_path


def parts(spark):
    pop = spark.createDataFrame([(3001 + i, [1, 0, i % 2, 0]) for i in range(6)], "stay_id long, labels array<int>")
    stays = spark.createDataFrame(
        [(3001 + i, 100 + i, u, p) for i, (u, p) in enumerate(zip("BABABA", ["train", "val", "train", "test", "train", "val"]))],
        "stay_id long, subject_id long, first_unit string, partition string",
    )
    notes = spark.createDataFrame(
        [(3001 + i, [i] * 8, [0] * 8, [1] * 8) for i in range(5)],
        "stay_id long, input_ids array<int>, token_type_ids array<int>, attention_mask array<int>",
    )
    return pop, notes, stays


def test_assembly_fills_missing_notes(spark):
    rows = splits.assemble(*parts(spark), None, 8).orderBy("stay_id").collect()
    assert [r["unit_code"] for r in rows] == [1, 0, 1, 0, 1, 0]
    assert [r["notes_available"] for r in rows] == [True] * 5 + [False]
    assert rows[-1]["input_ids"] == [101, 102, 0, 0, 0, 0, 0, 0] and rows[-1]["attention_mask"] == [1, 1] + [0] * 6


def test_overwrite_and_leaks_are_refused(spark):
    rows = splits.assemble(*parts(spark), None, 8)
    path = scratch_path(spark, "t")
    splits.write_split_table(rows, path)
    assert splits.read_split(spark, path, "val").count() == 2
    with pytest.raises(AnalysisException):
        splits.write_split_table(rows, path)
    leaky = rows.withColumn("subject_id", F.lit(7).cast("long"))
    with pytest.raises(checks.AuditError):
        splits.write_split_table(leaky, scratch_path(spark, "t"))
    nowhere = rows.withColumn("partition", F.when(F.col("stay_id") > 3001, F.col("partition")))
    with pytest.raises(checks.AuditError):
        splits.write_split_table(nowhere, scratch_path(spark, "t"))


def test_attach_is_idempotent_and_checks_labels(spark):
    pop, notes, stays = parts(spark)
    rows = splits.assemble(pop, notes, stays, None, 8)
    old = rows.drop("unit_code")
    once = splits.attach_columns(old, rows, "labels", ["unit_code"])
    assert "unit_code" in once.columns
    assert splits.attach_columns(once, rows, "labels", ["unit_code"]).columns == once.columns
    swapped = rows.withColumn("labels", F.reverse("labels"))
    with pytest.raises(checks.AuditError, match="labels differ"):
        splits.attach_columns(old, swapped, "labels", ["unit_code"])
    with pytest.raises(checks.AuditError, match="unit_code differs"):
        splits.attach_columns(once, rows.withColumn("unit_code", F.lit(9)), "labels", ["unit_code"])


def test_group_split_shares_and_row_order(spark):
    rng = np.random.default_rng(0)
    groups = spark.createDataFrame([(i,) for i in range(600)], "group_id long")
    pos = spark.createDataFrame(
        [(i, f"l{j}") for i in range(600) for j, p in enumerate((0.5, 0.2, 0.05)) if rng.random() < p], "group_id long, label string"
    )
    a = splits.group_split(groups, pos, 17)
    b = splits.group_split(groups.repartition(5), pos.repartition(3), 17)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    share = a.join(pos, "group_id").groupBy("label").agg(F.avg((F.col("partition") == "train").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.6) < 0.12 for r in share) and a.count() == 600


def scenario_rows(spark, n=500):
    rng = np.random.default_rng(1)
    part = ["train"] * 300 + ["val"] * 100 + ["test"] * 100
    rows = [(i, part[i], int(rng.integers(0, 3)), bool(rng.random() > 0.1), True, int(rng.integers(1, 9))) for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, partition string, unit_code int, notes_available boolean, series_available boolean, positives long"
    )


@pytest.mark.parametrize("bias", ["uniform", "label_sparse", "careunit"])
def test_withheld_rate_is_exact_per_split(spark, bias):
    rows = scenario_rows(spark)
    how = scenario.Withhold("notes", 0.4, bias, 2.0, seed=5, unit=1)
    out = scenario.withheld(rows, how, "notes_available")
    again = scenario.withheld(rows.repartition(7), how, "notes_available")
    assert sorted(map(tuple, out.select("id", "notes_missing").collect())) == sorted(map(tuple, again.select("id", "notes_missing").collect()))
    got = {r["partition"]: r["n"] for r in out.groupBy("partition").agg(F.count_if("notes_missing").alias("n")).collect()}
    assert got == {"train": 120, "val": 40, "test": 40}
    assert out.filter(~F.col("notes_available") & ~F.col("notes_missing")).isEmpty()
    if bias == "label_sparse":
        extra = out.filter("notes_available and notes_missing").agg(F.avg("positives")).first()[0]
        assert extra < out.filter("notes_available").agg(F.avg("positives")).first()[0]


def test_series_gaps_can_be_disjoint(spark):
    rows = scenario.withheld(scenario_rows(spark), scenario.Withhold("notes", 0.4, seed=0), "notes_available")
    out = scenario.withheld(rows, scenario.Withhold("series", 0.4, seed=0), "series_available", "notes_missing")
    assert scenario.scenario_summary(out, ["notes", "series"]).first()["both_missing_rows"] == 0


def test_label_subset_ignores_evaluation_rows(spark):
    names = spark.createDataFrame([(f"l{j}", j) for j in range(5)], "label string, ord int")
    train = spark.createDataFrame([(i, f"l{j}") for j in range(5) for i in range(5 - j)], "id long, label string")
    sub = {r["label"]: r["kept"] for r in scenario.label_subset(names, train, drop_top=2, minimum=2).collect()}
    assert sub == {"l0": False, "l1": False, "l2": True, "l3": True, "l4": False}
    poisoned = labels.frequency_ranks(train, names)
    assert poisoned.filter("label = 'l0'").first()["freq_rank"] == 1


def test_folds_keep_groups_whole_and_balanced(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 4) for i in range(40)], "g long, size long")
    out = splits.serpentine_folds(sizes, "g", "size", 4).groupBy("fold").agg(F.sum("size").alias("s")).collect()
    assert len(out) == 4 and max(r["s"] for r in out) - min(r["s"] for r in out) <= 4


def test_a_scenario_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = scenario_rows(spark)
    names = spark.createDataFrame([("a", 0), ("b", 1)], "label string, ord int")
    gaps = [scenario.Withhold(m, 0.4, seed=3) for m in ("notes", "series")]
    out, _subset = scenario.resolve(rows.mapInPandas(seen, rows.schema), names, names.select(F.lit(1).alias("id"), "label"), notes=gaps[0], series=gaps[1])
    assert out.count() == 500 and read.value == 500
