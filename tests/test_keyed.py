"""The keyed store: what it returns, and that its rows stay where they are."""

import pytest
from pyspark.sql import functions as F

from poolweave.operators import checks
from poolweave.sources import keyed


@pytest.fixture(scope="module")
def store(spark):
    rows = spark.range(5000).select((F.col("id") * 7).alias("id"), (F.col("id") % 10).alias("v"))
    return keyed.write_keyed(rows, "id", 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_are_located(spark, store):
    got = keyed.locate(spark, store, "id", [0, 7, 8, 34993, 35000])
    assert sorted(r["id"] for r in got.collect()) == [0, 7, 34993]
    one = keyed.locate(spark, store, "id", [7])
    assert "EqualTo(id,7)" in plan(one) and "Exchange" not in plan(one)
    files = one.select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1 and spark.table(store).select(F.input_file_name()).distinct().count() > 1
    assert keyed.locate(spark, store, "id", []).count() == 0


def test_joins_move_no_stored_row(spark, store):
    other = keyed.write_keyed(spark.range(0, 40000, 14).withColumn("w", F.lit(1)), "id", 8)
    both = keyed.paired(spark, store, other, "id")
    assert "Exchange" not in plan(both)
    assert both.count() == 2500


def test_wanted_rows_come_to_the_store(spark, store):
    wanted = spark.range(0, 35000, 21).unionByName(spark.range(0, 35000, 21))
    got = keyed.fetch(spark, store, "id", wanted)
    assert got.count() == len(range(0, 35000, 21))
    lines = plan(keyed.fetch(spark, store, "id", wanted)).split("\n")
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line or "SelectedBucketsCount" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*("))
    above = [x for x in lines[:scan] if "Exchange" in x and len(x) - len(x.lstrip(" :+-*(")) < depth]
    assert not above


def test_keys_must_be_unique(spark):
    for bad in ([(1,), (1,)], [(None,), (2,)]):
        with pytest.raises(checks.AuditError):
            keyed.write_keyed(spark.createDataFrame(bad, "id long"), "id", 2)
