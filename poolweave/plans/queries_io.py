"""Queries that write derived tables to the scratch folder and read them back."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import labels, resolution, selection, splits
from ..session import scratch_path
from ..sources import keyed, sinks, tables
from . import loop, methods
from .bindings import BRANDS, DUCK, SEED
from .oracle_views import R
from .registry import query

U = DUCK.u


def _csv(t, df, label):
    path = scratch_path(t.spark, label)
    df.write.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


@query("typed_csv_scan", "A1", "select stay_id, subject_id, first_ward, cast(epoch_us(intime) / 1000000 as bigint) as intime_s from raw_stays")
def _(t):
    back = {v: k for k, v in tables.NAMES.items()}
    names = ["subject_id", "hadm_id", "stay_id", "dbsource", "first_unit", "last_unit", "first_ward", "last_ward", "intime", "outtime"]
    path = _csv(t, t.raw_stays.select(*[F.col(n).alias(back[n]) for n in names]), "stays-csv")
    out = tables.raw_table(t.spark, "icustays", path)
    return out.select("stay_id", "subject_id", "first_ward", F.unix_seconds("intime").alias("intime_s"))


@query("numbered_notes", "A3", "select conv_id, count(*) as notes, count(*) as numbers, true as in_order from conversations group by conv_id")
def _(t):
    src = t.raw("conversations").orderBy("conv_id", "turn").select(
        F.col("conv_id").alias("SUBJECT_ID"), F.col("turn").alias("HADM_ID"), F.lit(None).cast("timestamp").alias("CHARTTIME"),
        F.lit(None).cast("string").alias("ISERROR"), F.col("role").alias("CATEGORY"), F.lit("Report").alias("DESCRIPTION"), F.col("text").alias("TEXT"),
    )
    path = _csv(t, src, "notes-csv")
    out = tables.numbered_notes(t.spark, path, scratch_path(t.spark, "notes"))
    turns = F.array_sort(F.collect_list(F.struct("source_row", "hadm_id")))
    by_row = F.transform(turns, lambda x: x["hadm_id"])
    return out.groupBy(F.col("subject_id").alias("conv_id")).agg(
        F.count("*").alias("notes"), F.countDistinct("source_row").alias("numbers"), (by_row == F.array_sort(by_row)).alias("in_order")
    )


@query("experiment_metric_scan", "A11 M12", f"""
    select lower(c_mktsegment) as experiment, 'r' as strategy, {R('avg(c_acctbal)')} as "test.balance" from customer group by c_mktsegment""")
def _(t):
    root = scratch_path(t.spark, "runs")
    rows = t.raw("customer").groupBy(F.lower("c_mktsegment").alias("experiment")).agg(F.avg("c_acctbal").alias("balance"))
    rows = rows.select("experiment", F.lit("r").alias("strategy"), F.struct("balance").alias("test"), F.array(F.lit(1)).alias("curve"))
    paths = []
    for r in rows.select("experiment").collect():  # one run for each of the five segments
        paths.append(f"{root}/{r.experiment}/final_metrics.json")
        rows.filter(F.col("experiment") == r.experiment).drop("experiment").coalesce(1).write.json(paths[-1])
    return resolution.metric_matrix(tables.experiment_metrics(t.spark, paths, depth=2))


@query("shard_manifest", "A13", "select count(*) as rows, true as bounded from lineitem")
def _(t):
    path = scratch_path(t.spark, "shards")
    sinks.write_shards(t.raw("lineitem").select("l_orderkey", "l_linenumber"), path, 1000)
    return sinks.shard_manifest(t.spark, path).agg(F.sum("rows").alias("rows"), (F.max("rows") <= 1000).alias("bounded"))


@query("overwrite_refused", "A15 C15", "select count(*) as stays, true as refused from split_stays")
def _(t):
    path = scratch_path(t.spark, "splits")
    splits.write_split_table(t.split_stays.drop("intime", "outtime"), path)
    try:
        splits.write_split_table(t.split_stays.drop("intime", "outtime"), path)
        refused = False
    except AnalysisException:
        refused = True
    return splits.read_split(t.spark, path).agg(F.count("*").alias("stays")).withColumn("refused", F.lit(refused))


@query("split_table_pruned_read", "A10 I11", "select stay_id, subject_id from split_stays where partition = 'val'")
def _(t):
    path = scratch_path(t.spark, "splits")
    splits.write_split_table(t.split_stays.drop("intime", "outtime"), path)
    return splits.read_split(t.spark, path, "val").select("stay_id", "subject_id")


@query("keyed_store_lookup", "A10", """
    select 'located' as part, stay_id, subject_id from split_stays where stay_id in (select stay_id from split_stays order by stay_id limit 3)
    union all select 'fetched', stay_id, subject_id from split_stays where partition = 'val'
    union all select 'paired', s.stay_id, s.subject_id from split_stays s where s.partition <> 'val'""")
def _(t):
    rows = t.split_stays.select("stay_id", "subject_id", "partition")
    store = keyed.write_keyed(rows, "stay_id", 8)
    rest = keyed.write_keyed(rows.filter("partition <> 'val'").select("stay_id"), "stay_id", 8)
    first = [r["stay_id"] for r in rows.select("stay_id").orderBy("stay_id").limit(3).collect()]
    parts = {
        "located": keyed.locate(t.spark, store, "stay_id", first),
        "fetched": keyed.fetch(t.spark, store, "stay_id", rows.filter("partition = 'val'")),
        "paired": keyed.paired(t.spark, store, rest, "stay_id"),
    }
    shown = [df.select(F.lit(name).alias("part"), "stay_id", "subject_id") for name, df in parts.items()]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("label_matrix_sink", "A14", """
    select 'matrix' as part, count(*) as rows from stays union all select 'counts', count(distinct label) from stay_labels""")
def _(t):
    path = scratch_path(t.spark, "matrix")
    sinks.write_label_matrix(t.stays, labels.stay_groups(t.coded), BRANDS, path)
    parts = [t.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("rows")) for p in ("matrix", "counts")]
    return parts[0].unionByName(parts[1]).select("part", "rows")


@query("metric_matrix_sink", "A18", f"""select c_custkey as run, {R('c_acctbal')} as "test.balance" from customer""")
def _(t):
    runs = t.raw("customer").select(F.col("c_custkey").alias("run"), F.struct(F.col("c_acctbal").alias("balance")).alias("test"))
    path = scratch_path(t.spark, "matrix") + ".csv"
    sinks.write_metric_matrix([runs], path)
    out = t.spark.read.option("header", True).csv(path)
    return out.select(F.col("run").cast("bigint").alias("run"), F.col("`test.balance`").cast("double").alias("test.balance"))


@query("run_manifest", "A19", "select 1 as schema_version, 'cohort' as task, 'random' as method, cast(count(*) as varchar) as pool, true as has_revision from vec")
def _(t):
    pool = t.pool.count()
    path = scratch_path(t.spark, "manifest")
    sinks.write_run_manifest(sinks.run_manifest(t.spark, "cohort", "random", {"pool": str(pool), "seed": str(SEED)}), path)
    out = t.spark.read.json(path)
    return out.select(
        F.col("schema_version").cast("int").alias("schema_version"), "task", "method", F.col("settings.pool").alias("pool"),
        (F.length("revision") > 0).alias("has_revision"),
    )


@query("prediction_sink", "A12", "select split, count(*) as cells, sum(y)::bigint as positives from cells group by split")
def _(t):
    path = scratch_path(t.spark, "predictions")
    sinks.write_predictions(t.cells.select("id", "label", "y", "p", "split").withColumn("arm", F.lit("random")), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("cells"), F.sum("y").alias("positives"))


@query("fresh_start_replaces_round", "N10 N4", f"""
    select id, 'second' as run_id from (select id from vec order by {U(18, 'initial', 'id')}, id limit 20) x""")
def _(t):
    state = loop.RunState(t.spark, scratch_path(t.spark, "rounds"))
    none = t.pool.agg(F.count("*").cast("double").alias("value")).select(F.lit("pool").alias("metric"), "value")
    for run, seed in (("first", SEED), ("second", SEED), ("second", SEED + 1)):
        s = loop.RunSettings(run, "random", seed, (20,))
        state.write_round(s, 0, selection.initial_selection(t.pool, 20, seed), "initial", none)
    return state.labeled("second").select("id", "run_id")


@query("registered_method", "U1 U2 U3 N7", "select id, row_number() over (order by id) as rank from vec where role = 'candidate' order by id limit 15")
def _(t):
    def lowest(c: methods.Context):
        return c.candidates.orderBy("id").limit(c.budget).select("id", F.row_number().over(methods.by_id()).cast("bigint").alias("rank"))

    methods.register(methods.Method("lowest_id", lowest, ("id",)))
    return methods.acquire("lowest_id", methods.Context(t.role("candidate"), t.role("labeled"), 15))


def _decode(path: str, content: bytes):
    """An injected reader: text lines ``study,lead,t,mv`` of the recordings in a file."""
    rows = pd.read_csv(io.BytesIO(content), names=["study", "lead", "t", "mv"], dtype={"lead": str}, keep_default_na=False, float_precision="round_trip")
    rows = rows.sort_values(["study", "lead", "t"], kind="stable")
    studies: dict[int, dict[str, np.ndarray]] = {}
    for (study, lead), part in rows.groupby(["study", "lead"], sort=False)["mv"]:
        studies.setdefault(int(study), {})[lead] = part.to_numpy(float)
    return [(study, 100.0, leads) for study, leads in studies.items()]


#: Studies of a file; a file each takes more time to create, rename and list than to read.
STUDIES = 64


@query("signals_from_reader", "U5", f"select study_id, lead, t, {R('mv')} as mv from sig where mv is not null and lead = 'I' and t < 0 union all select study_id, lead, cast(row_number() over (partition by study_id, lead order by t) - 1 as int), {R('mv')} from sig where mv is not null")
def _(t):
    path = scratch_path(t.spark, "signals")
    known = t.sig.filter("mv is not null").select(F.concat_ws(",", "study_id", "lead", "t", "mv").alias("value"), F.expr(f"study_id div {STUDIES}").alias("studies"))
    known.repartition("studies").write.partitionBy("studies").text(path)
    return tables.signals_from_files(t.spark, path, _decode, "*.txt")
