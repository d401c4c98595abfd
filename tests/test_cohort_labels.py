"""Hand cases of the cohort rules and label selection."""

import pytest
from pyspark.sql import functions as F

from poolweave.functions import columns as C
from poolweave.operators import checks, cohort, labels


def raw(spark, extra=()):
    """Two clean stays (24 h and 12 h) plus the named violations."""
    stays = [(1, 10, 90001, "A", "A", "1", "1", 24), (2, 20, 90002, "A", "A", "1", "1", 12)]
    born = {1: "2050-01-01", 2: "2060-01-01"}
    if "transfer" in extra:
        stays.append((3, 30, 90003, "A", "B", "1", "1", 24))
        born[3] = "2050-01-01"
    if "double" in extra:
        stays += [(4, 40, 90004, "A", "A", "1", "1", 24), (4, 40, 90005, "A", "A", "1", "1", 24)]
        born[4] = "2050-01-01"
    if "child" in extra:
        stays.append((6, 60, 90006, "A", "A", "1", "1", 24))
        born[6] = "2100-06-01"
    if "old" in extra:
        stays.append((7, 70, 90007, "A", "A", "1", "1", 24))
        born[7] = "2300-01-01"
    s = spark.createDataFrame(
        stays, "subject_id long, hadm_id long, stay_id long, first_unit string, last_unit string, first_ward string, last_ward string, h int"
    )
    s = s.withColumn("intime", F.lit("2101-01-01 00:00:00").cast("timestamp")).withColumn("dbsource", F.lit("x"))
    s = s.withColumn("outtime", F.col("intime") + F.make_dt_interval(hours=F.col("h"))).drop("h")
    a = s.select("subject_id", "hadm_id").distinct().withColumn("ethnicity", F.lit("e"))
    p = spark.createDataFrame([(k, "F", v) for k, v in born.items()], "subject_id long, gender string, b string")
    return s, a, p.select("subject_id", "gender", F.col("b").cast("timestamp").alias("born"))


@pytest.mark.parametrize("violation", ["transfer", "double", "child"])
def test_a_violation_drops_only_its_stay(spark, violation):
    out = cohort.benchmark_stays(*raw(spark, [violation]))
    assert {r["stay_id"] for r in out.collect()} == {90001, 90002}


def test_shifted_birth_reads_as_ninety(spark):
    out = {r["stay_id"]: r for r in cohort.benchmark_stays(*raw(spark, ["old"])).collect()}
    assert out[90007]["age"] == 90.0
    assert out[90001]["los_hours"] == 24.0 and out[90002]["los_hours"] == 12.0


def test_a_transfer_does_not_count_as_second_stay(spark):
    s, a, p = raw(spark)
    moved = s.filter("stay_id = 90001").withColumn("stay_id", F.lit(90009).cast("long")).withColumn("last_unit", F.lit("B"))
    out = cohort.benchmark_stays(s.unionByName(moved), a, p)
    assert {r["stay_id"] for r in out.collect()} == {90001, 90002}


def test_partition_lists(spark):
    stays = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    one = lambda x: spark.createDataFrame([(x,)], "subject_id long")
    out = {r["subject_id"]: r["partition"] for r in cohort.assign_partitions(stays, one(1), one(2)).collect()}
    assert out == {1: "test", 2: "val", 3: "train"}
    with pytest.raises(checks.AuditError):
        cohort.assign_partitions(stays, one(1), one(1))


def groups(spark):
    return spark.createDataFrame(
        [("Beta", 2, True, ["001"]), ("Alpha", 1, False, ["002"]), ("Rare", 3, False, ["003"])],
        "grp string, group_id int, use_flag boolean, codes array<string>",
    )


def test_minimum_episode_labels(spark):
    stays = spark.createDataFrame([(11,), (22,), (33,)], "stay_id long")
    dx = spark.createDataFrame([(11, "001"), (22, "001"), (22, "002"), (33, "002"), (33, "999999")], "stay_id long, code string")
    coded = labels.attach_groups(dx, labels.group_dimension(groups(spark)))
    names = labels.frequent_names(coded, groups(spark), stays, 2)
    assert [r["label"] for r in names.orderBy("ord").collect()] == ["Alpha", "Beta"]
    wide = labels.label_matrix(stays, labels.stay_groups(coded), ["Alpha", "Beta"]).orderBy("stay_id").collect()
    assert [(r["Alpha"], r["Beta"]) for r in wide] == [(0, 1), (1, 1), (1, 0)]
    with pytest.raises(checks.AuditError):
        labels.frequent_names(coded, groups(spark), stays, 2, expected=3)
    flagged = labels.flagged_labels(stays, coded, groups(spark)).collect()
    assert {(r["stay_id"], r["label"]) for r in flagged} == {(11, "Beta"), (22, "Beta")}


def test_counting_outside_the_cohort_is_an_option(spark):
    stays = spark.createDataFrame([(11,)], "stay_id long")
    dx = spark.createDataFrame([(11, "001"), (22, "001")], "stay_id long, code string")
    coded = labels.attach_groups(dx, labels.group_dimension(groups(spark)))
    assert labels.frequent_labels(stays, coded, groups(spark), 2).count() == 0
    assert labels.frequent_labels(stays, coded, groups(spark), 2, count_all=True).count() == 1


def test_group_dimension_findings(spark):
    bad = groups(spark).unionByName(
        spark.createDataFrame([("Other", 2, False, ["001"])], "grp string, group_id int, use_flag boolean, codes array<string>")
    )
    found = {r["check"]: r["violations"] for r in labels.group_dimension_findings(bad).collect()}
    assert found == {"code in two groups": 1, "group id used twice": 1}


@pytest.mark.parametrize(
    "code,want",
    [("V4501", "V45"), ("V4", None), ("E8490", "E849"), ("E84", "E84"), ("E8", None), ("25000", "250"), ("25", None), (" 410.71 ", "410"), ("", None), (None, None)],
)
def test_diagnosis_group3(spark, code, want):
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(C.diagnosis_group3(F.col("code"))).first()[0] == want


def test_top_groups_break_ties_by_first_row(spark):
    dx = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("a", 3), ("c", 4)], "grp string, source_row long")
    assert [r["grp"] for r in labels.top_groups(dx, 1).collect()] == ["b"]
    assert [r["grp"] for r in labels.top_groups(dx, 2).orderBy("ord").collect()] == ["a", "b"]
