"""Typed scans of the raw tables, small dimensions and experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks

# Column names and types of the raw tables.
SCHEMAS: dict[str, str] = {
    "patients": "SUBJECT_ID long, GENDER string, DOB timestamp, DOD timestamp",
    "admissions": "SUBJECT_ID long, HADM_ID long, ADMITTIME timestamp, DISCHTIME timestamp, ETHNICITY string",
    "icustays": (
        "SUBJECT_ID long, HADM_ID long, ICUSTAY_ID long, DBSOURCE string, FIRST_CAREUNIT string, "
        "LAST_CAREUNIT string, FIRST_WARDID string, LAST_WARDID string, INTIME timestamp, OUTTIME timestamp"
    ),
    "events": (
        "SUBJECT_ID long, ICUSTAY_ID long, CHARTTIME timestamp, ITEMID int, VALUE string, VALUEUOM string"
    ),
    "lab_events": "SUBJECT_ID long, CHARTTIME timestamp, ITEMID int, VALUE string, VALUEUOM string",
    "notes": (
        "SUBJECT_ID long, HADM_ID long, CHARTTIME timestamp, ISERROR string, CATEGORY string, "
        "DESCRIPTION string, TEXT string"
    ),
    "diagnoses": "SUBJECT_ID long, HADM_ID long, SEQ_NUM int, ICD9_CODE string",
    "subject_list": "subject_id long, flag int",
}

# Raw names and the names the operators use.
NAMES = {
    "SUBJECT_ID": "subject_id",
    "HADM_ID": "hadm_id",
    "ICUSTAY_ID": "stay_id",
    "GENDER": "gender",
    "DOB": "born",
    "ETHNICITY": "ethnicity",
    "DBSOURCE": "dbsource",
    "FIRST_CAREUNIT": "first_unit",
    "LAST_CAREUNIT": "last_unit",
    "FIRST_WARDID": "first_ward",
    "LAST_WARDID": "last_ward",
    "INTIME": "intime",
    "OUTTIME": "outtime",
    "CHARTTIME": "charttime",
    "ITEMID": "item_id",
    "VALUE": "value",
    "VALUEUOM": "uom",
    "ISERROR": "iserror",
    "CATEGORY": "category",
    "DESCRIPTION": "description",
    "TEXT": "text",
    "SEQ_NUM": "seq",
    "ICD9_CODE": "code",
}


def typed_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    columns: list[str] | None = None,
    header: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a declared schema matched by header name; only ``columns`` are parsed.

    Code columns are declared as strings, so leading zeros survive. ``multiline`` is for
    quoted line breaks; such files cannot be split, so long tables should come in many.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", header).option("multiLine", multiline).option("escape", '"')
    if header:
        names = reader.csv(path).columns
        types = {f.name: f.dataType for f in declared.fields}
        missing = [f.name for f in declared.fields if f.name not in names]
        if missing:
            raise checks.AuditError(f"{path} is missing columns {missing}")
        declared = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        wanted = columns or [n for n in types]
    else:
        wanted = columns or declared.names
    return reader.schema(declared).csv(path).select(*wanted)


def named(df: DataFrame) -> DataFrame:
    """Raw column names to the names the operators use."""
    return df.select(*[F.col(c).alias(NAMES.get(c, c.lower())) for c in df.columns])


def raw_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return named(typed_csv(spark, path, SCHEMAS[kind], multiline=kind == "notes"))


def subject_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["subject_list"]).csv(path)


def with_source_row(df: DataFrame, out: str = "source_row") -> DataFrame:
    """Number rows in file order: (file, offset of the split, row inside it) as one long.

    Splits are ranked by path and offset on a table with one row per split, so the order
    does not depend on how Spark packs files into tasks. The number is for ingest: write
    the result once and read it from there.
    """
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    splits = df.select(*place).distinct()
    ranked = splits.withColumn("_k", F.row_number().over(Window.orderBy("_f", "_b")).cast("bigint"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select("*", *place, inside.alias("_i"))
    number = F.shiftleft(F.col("_k"), 33) + F.col("_i")
    return rows.join(ranked, ["_f", "_b"]).withColumn(out, number).drop("_f", "_b", "_k", "_i")


def numbered_notes(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Notes with the global source-row number that breaks ties, written once."""
    raw = typed_csv(spark, path, SCHEMAS["notes"], multiline=True)
    checks.write_new(named(with_source_row(raw)), out)
    return spark.read.parquet(out)


def group_definitions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Code groups from JSON lines {grp, group_id, use_flag, codes[]}; a code in two groups or a group
    id used twice raises unless ``strict`` is off, where ``group_dimension_findings`` counts them."""
    out = spark.read.schema("grp string, group_id int, use_flag boolean, codes array<string>").json(path)
    if strict:
        from ..operators.labels import group_dimension_findings

        checks.enforce(group_dimension_findings(out))
    return out


def item_map_file(spark: SparkSession, path: str) -> DataFrame:
    """Item map CSV to (item_id, variable, item_label) of ready and used items."""
    from ..operators.events import item_map

    raw = spark.read.option("header", True).csv(path)
    return item_map(
        raw.select(
            F.col("ITEMID").alias("item_id"),
            F.coalesce("LEVEL2", F.lit("")).alias("level2"),
            F.col("COUNT").try_cast("int").alias("count"),
            F.coalesce("STATUS", F.lit("")).alias("status"),
            F.coalesce(F.col("`MIMIC LABEL`"), F.lit("")).alias("label"),
        )
    )


def file_stems(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """File names without folder and extension; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("item_id"))


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Record list CSV (subject_id, study_id, path) with its row number as tie-break."""
    return with_source_row(typed_csv(spark, path, "subject_id long, study_id long, path string"))


def records_from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Fallback without a list: ids from the header paths ``p<subject>/s<study>/<x>.hea``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hea").option(
        "recursiveFileLookup", True
    ).load(folder).select("path")
    part = lambda letter: F.regexp_extract("path", rf"/{letter}(\d+)/", 1)
    found = files.select(
        F.regexp_extract("path", r"/p(\d+)/[^/]*s\d+/", 1).try_cast("long").alias("subject_id"),
        part("s").try_cast("long").alias("study_id"),
        F.regexp_replace("path", r"\.hea$", "").alias("path"),
    )
    return found.filter(F.col("study_id").isNotNull()).withColumn("source_row", F.xxhash64("path"))


def experiment_metrics(spark: SparkSession, paths: list[str], depth: int = 1) -> list[DataFrame]:
    """JSON metrics objects of run folders, read at once with a merged schema, each tagged with the
    folder ``depth`` levels above its file (2 where the object is itself a folder of parts)."""
    files = [p if p.endswith(".json") else f"{p}/final_metrics.json" for p in paths]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-1 - depth))
    return [spark.read.option("multiLine", True).json(files).select(F.url_decode(name).alias("experiment"), "*")]


def signals_from_files(spark: SparkSession, folder: str, reader, pattern: str = "*") -> DataFrame:
    """Long signals through an injected reader ``content -> (study_id, fs, {lead: values})``, or a list
    of these where a file holds several recordings. A file's rows leave as one frame."""
    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True
    ).load(folder)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = reader(path, content)
                parts = [(r[0], lead, v) for r in ([found] if isinstance(found, tuple) else found) for lead, v in r[2].items()]
                sizes = [len(v) for _, _, v in parts]
                if sum(sizes):
                    columns = {"study_id": np.repeat([s for s, _, _ in parts], sizes), "lead": np.repeat([n for _, n, _ in parts], sizes)}
                    columns["t"] = np.concatenate([np.arange(n) for n in sizes])
                    columns["mv"] = np.concatenate([np.asarray(v, float) for _, _, v in parts])
                    yield pd.DataFrame(columns)

    return files.select("path", "content").mapInPandas(run, "study_id long, lead string, t int, mv double")
