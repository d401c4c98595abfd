"""Queries on the smallest tables with what larger copies bring: keys that meet, ties, many row groups."""

import os

import duckdb
import pandas as pd

from poolweave.plans import registry
from poolweave.plans.bindings import Tables
from poolweave.plans.dialect import Spark
from poolweave.plans.queries_io import _decode
from poolweave.sources import sinks, tables
from poolweave.streaming.events import CarryForward
from tests.compare import check, connect

SOURCE = "/root/testdata/sf0.001"


def folder_with(tmp_path, **changed):
    """The smallest tables, some of them replaced: {name: SQL over the table ``old``}."""
    for file in os.listdir(SOURCE):
        name = file.removesuffix(".parquet")
        if name in changed:
            text = f"with old as (select * from '{SOURCE}/{file}') {changed[name]}"
            duckdb.connect().execute(f"copy ({text}) to '{tmp_path}/{file}' (row_group_size 2048)")
        else:
            os.symlink(f"{SOURCE}/{file}", tmp_path / file)
    return str(tmp_path)


def difference(spark, name, folder):
    con = connect(folder)
    con.execute("set threads = 1")
    return check(spark, con, registry.load()[name], folder)


def test_group_dimension_has_codes_of_two_groups(spark, tmp_path):
    twice = "select * from old union all select p_partkey + 1000000, p_name, 'Brand#' || (1 + p_partkey % 25), p_type, p_size, p_retailprice from old"
    assert difference(spark, "group_dimension", folder_with(tmp_path, part=twice)) == ""


def test_first_record_of_equal_places_is_the_first_row(spark, tmp_path):
    tied = "select * replace (1 as l_partkey, 1 as l_linenumber, (l_suppkey * 7 + row_number() over ()) % 1000 as l_suppkey) from old"
    folder = folder_with(tmp_path, lineitem=tied)
    # A cluster's shuffle hands rows over in any order; here the view shows them last row first.
    rows = f"select * exclude (file_row_number) from read_parquet('{folder}/lineitem.parquet', file_row_number = true)"
    duckdb.connect().execute(f"copy ({rows} order by file_row_number desc) to '{tmp_path}/turned.parquet'")
    spark.read.parquet(f"{tmp_path}/turned.parquet").createOrReplaceTempView(Spark(spark, folder).t("lineitem"))
    assert difference(spark, "first_record_per_study", folder) == ""


def test_column_fit_counts_equal_rows_once(spark, tmp_path):
    # One customer's orders for everyone, in other orders: one mean of the same prices.
    prices = "(select o_totalprice as p, row_number() over () as k from old limit 40)"
    same = f"select o_orderkey, c as o_custkey, o_orderstatus, p as o_totalprice, o_orderdate, o_orderpriority from {prices} x, range(100) r(c), (select * exclude (o_custkey, o_totalprice) from old limit 1) order by hash(k * 1000 + c)"
    spends = {r["column"]: r["distinct_values"] for r in registry.runner(registry.load()["column_fit"])(spark, folder_with(tmp_path, orders=same)).collect()}
    assert spends["biometrics_spend"] == 1


def test_a_file_of_several_recordings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("7,II,1,0.5\n7,II,0,0.25\n8,I,3,1.5\n")
    rows = tables.signals_from_files(spark, str(tmp_path), _decode, "*.txt").collect()
    assert sorted(map(tuple, rows)) == [(7, "II", 0, 0.25), (7, "II", 1, 0.5), (8, "I", 0, 1.5)]
    one = tables.signals_from_files(spark, str(tmp_path), lambda path, content: (3, 1.0, {"I": [1, 2], "V": []}), "*.txt").collect()
    assert sorted(map(tuple, one)) == [(3, "I", 0, 1.0), (3, "I", 1, 2.0)]


class _States:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, *schema):
        return _State(self)

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class _State:
    def __init__(self, store):
        self.store, self.held = store, {}

    def __getattr__(self, name):
        self.store.calls += 1
        return {
            "exists": lambda: bool(self.held), "get": lambda: self.held[None], "update": lambda v: self.held.update({None: v}), "clear": self.held.clear,
            "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}), "iterator": lambda: iter(self.held.items()),
        }[name]


def test_carry_forward_calls_the_store_as_often_for_many_bins():
    calls = []
    for n in (2, 200):
        store, rule = _States(), CarryForward()
        rule.init(store)
        for shift in (0.0, 0.5):
            part = pd.DataFrame({"variable": "hr", "bin": range(n), "hours": [b + shift for b in range(n)], "num": [b + shift for b in range(n)], "bins": n + 3, "ends_ms": 9})
            assert all(out.empty for out in rule.handleInputRows((5,), iter([part[::-1], part]), None))
        calls.append(store.calls)
        out = next(rule.handleExpiredTimer((5,), None, None))
        assert store.timers == [9]
        assert out.values.tolist() == [[5, "hr", b, b + 1 if b < n - 1 else n + 3, b + 0.5] for b in range(n)]
    assert calls[0] == calls[1]


def test_cells_are_made_after_the_joins(spark):
    plan = Tables(spark, SOURCE).cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")


def test_a_manifest_cuts_names_out_once_a_file(spark, tmp_path):
    rows = spark.range(25).selectExpr("id", "id % 2 as half").coalesce(1)
    sinks.write_shards(rows, str(tmp_path / "t" / "a"), 10)
    (tmp_path / "t" / "b").mkdir()
    for file in (tmp_path / "t" / "a").glob("*.parquet"):  # files of one name in two folders count as one
        (tmp_path / "t" / "b" / file.name).write_bytes(file.read_bytes())
    found = sinks.shard_manifest(spark.newSession(), f"{tmp_path}/t/*")
    assert sorted(r["rows"] for r in found.collect()) == [10, 20, 20]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    per_row = plan[plan.rindex("Project"):]
    assert "file_path" in per_row and "regexp" not in per_row and "substring_index" not in per_row


def test_frame_totals_stay_short_enough_to_be_compiled(spark):
    df = registry.load()["frame_vectors"].run(Tables(spark, SOURCE)).select("measured", "categories", "observed")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("AS DOUBLE") < 20
