"""Raw measurement events: union scan, cleaning, attribution to stays, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, contains_any_case, hours_between, number

EVENT_COLUMNS = ["subject_id", "stay_id", "charttime", "item_id", "value", "uom"]


def event_scan(*tables: DataFrame) -> DataFrame:
    """Union of event tables; a table without the stay id gets NULL there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    if "stay_id" not in out.columns:
        out = out.withColumn("stay_id", F.lit(None).cast("bigint"))
    return out.select(*EVENT_COLUMNS)


def item_map(raw: DataFrame) -> DataFrame:
    """Items that are ready and used: item -> (variable, item label)."""
    kept = raw.filter((F.col("level2") != "") & (F.col("count") > 0) & (F.col("status") == "ready"))
    return kept.select(
        F.col("item_id").cast("int").alias("item_id"),
        F.col("level2").alias("variable"),
        F.col("label").alias("item_label"),
    )


def in_scope(events: DataFrame, stays: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of cohort subjects and mapped items with a chart time, before any cleaning."""
    return (
        events.filter(F.col("charttime").isNotNull())
        .join(items.select("item_id"), "item_id", "left_semi")
        .join(stays.select("subject_id"), "subject_id", "left_semi")
    )


def systolic(value: Column) -> Column:
    return F.coalesce(number(value), F.regexp_extract(value, r"^(\d+)/(\d+)$", 1).try_cast("double"))


def diastolic(value: Column) -> Column:
    return F.coalesce(number(value), F.regexp_extract(value, r"^(\d+)/(\d+)$", 2).try_cast("double"))


def capillary_refill(value: Column) -> Column:
    # The wordings that count as normal and abnormal.
    return F.when(value.isin("Normal <3 secs", "Brisk"), F.lit(0.0)).when(
        value.isin("Abnormal >3 secs", "Delayed"), F.lit(1.0)
    )


def oxygen_fraction(value: Column, uom: Column) -> Column:
    v = number(value)
    return F.when(~contains_any_case(uom, "torr") & (v > 1.0), v / F.lit(100.0)).otherwise(v)


def lab_value(value: Column) -> Column:
    return number(value)


def oxygen_saturation(value: Column) -> Column:
    v = number(value)
    return F.when(v <= 1, v * F.lit(100.0)).otherwise(v)


def temperature(value: Column, uom: Column, label: Column) -> Column:
    v = number(value)
    fahrenheit = contains_any_case(uom, "f") | contains_any_case(label, "f") | (v >= 79)
    return F.when(fahrenheit, (v - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)).otherwise(v)


def weight(value: Column, uom: Column, label: Column) -> Column:
    v = number(value)
    ounces = contains_any_case(uom, "oz") | contains_any_case(label, "oz")
    pounds = contains_any_case(uom, "lb") | contains_any_case(label, "lb")
    return (
        F.when(ounces, v / F.lit(16.0) * F.lit(0.453592))
        .when(pounds, v * F.lit(0.453592))
        .otherwise(v)
    )


def height(value: Column, uom: Column, label: Column) -> Column:
    v = number(value)
    inches = contains_any_case(uom, "in") | contains_any_case(label, "in")
    return F.when(inches, F.rint(v * F.lit(2.54))).otherwise(v)


def cleaned_value(variable: Column, value: Column, uom: Column, label: Column) -> Column:
    """Numeric value for every variable that has a cleaner."""
    return (
        F.when(variable == "Capillary refill rate", capillary_refill(value))
        .when(variable == "Systolic blood pressure", systolic(value))
        .when(variable == "Diastolic blood pressure", diastolic(value))
        .when(variable == "Fraction inspired oxygen", oxygen_fraction(value, uom))
        .when(variable == "Oxygen saturation", oxygen_saturation(value))
        .when(variable.isin("Glucose", "pH"), lab_value(value))
        .when(variable == "Temperature", temperature(value, uom, label))
        .when(variable == "Weight", weight(value, uom, label))
        .when(variable == "Height", height(value, uom, label))
    )


# The variables above; all others keep their text.
CLEANED = [
    "Capillary refill rate",
    "Systolic blood pressure",
    "Diastolic blood pressure",
    "Fraction inspired oxygen",
    "Oxygen saturation",
    "Glucose",
    "pH",
    "Temperature",
    "Weight",
    "Height",
]


def clean_events(events: DataFrame, items: DataFrame) -> DataFrame:
    """Map items to variables, clean by variable and drop what does not parse.

    ``num`` is the numeric value where one exists, ``txt`` the text that categorical
    channels look up. The item map is a dimension; Spark broadcasts it by its size.
    """
    mapped = events.join(items, "item_id")
    cleaned = cleaned_value(F.col("variable"), F.col("value"), F.col("uom"), F.col("item_label"))
    has_cleaner = F.col("variable").isin(CLEANED)
    out = mapped.withColumn("num", F.when(has_cleaner, cleaned).otherwise(number(F.col("value"))))
    out = out.withColumn(
        "txt", F.when(has_cleaner, F.col("num").cast("string")).otherwise(F.col("value"))
    )
    return out.filter(F.when(has_cleaner, F.col("num").isNotNull()).otherwise(F.col("value").isNotNull()))


def attribute(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Interval join: an event belongs to a stay of its subject if the ids agree or its
    time lies inside the stay; it may belong to several stays.

    The subject equality makes this a hash or sort-merge join with a residual predicate;
    a subject with very many events is split by the adaptive skew-join rule.
    """
    e = events.withColumnRenamed("stay_id", "_event_stay")
    s = stays.select("subject_id", "stay_id", "intime", "outtime", "los_hours")
    hit = F.coalesce(F.col("_event_stay") == F.col("stay_id"), F.lit(False)) | F.col(
        "charttime"
    ).between(F.col("intime"), F.col("outtime"))
    joined = e.join(s, "subject_id").filter(hit)
    joined = joined.withColumn("hours", hours_between("charttime", "intime"))
    return in_stay_hours(joined).select("stay_id", "variable", "hours", "num", "txt")


def in_stay_hours(df: DataFrame) -> DataFrame:
    return df.filter((F.col("hours") > -EPS) & (F.col("hours") < F.col("los_hours") + F.lit(EPS)))


# Stands for a text that is in no category list; frames report or drop it.
UNKNOWN_TEXT = "<unknown>"
UNKNOWN_CODE = 62


def value_order(text: str) -> tuple[bool, float, str]:
    """Total order of category texts: first those that are no numbers, by text, then numbers by
    value and, at equal values, by text."""
    try:
        return True, float(text), text
    except ValueError:
        return False, 0.0, text


def category_codes(categories: dict[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """(code of the row's text, table from variable to its coded values).

    A code is the position in the order of ``value_order``, so the largest code is the largest
    value; it is NULL for variables without categories.
    """
    ordered = {v: sorted(values, key=value_order) for v, values in categories.items()}
    pairs = [x for v, vals in ordered.items() for i, t in enumerate(vals) for x in (F.lit(f"{v}->{t}"), F.lit(i))]
    found = F.try_element_at(F.create_map(*pairs), F.concat("variable", F.lit("->"), "txt"))
    code = F.when(F.col("variable").isin(list(ordered)), F.coalesce(found, F.lit(UNKNOWN_CODE)))
    entry = lambda i, t: F.struct(F.lit(i).alias("code"), F.lit(1 << i).cast("bigint").alias("bit"), F.lit(t).alias("txt"))
    rows = [
        x
        for v, vals in ordered.items()
        for x in (F.lit(v), F.array(*[entry(i, t) for i, t in enumerate(vals)], entry(UNKNOWN_CODE, UNKNOWN_TEXT)))
    ]
    return code, F.create_map(*rows)


def largest_per_time(events: DataFrame, categories: dict[str, tuple[str, ...]]) -> DataFrame:
    """One value per (stay, variable, time): the largest number, or else the last text.

    Values compare as numbers where they parse, and a number beats any text that does not.
    Categories are compared by their code, so both maxima are fixed-width buffers and the
    aggregate needs no sort.
    """
    code, table = category_codes(categories)
    grouped = (
        events.withColumn("_code", code)
        .groupBy("stay_id", "variable", "hours")
        .agg(F.max(F.when(F.col("_code").isNull(), F.col("num"))).alias("_num"), F.max("_code").alias("_code"))
    )
    entries = F.filter(F.try_element_at(table, F.col("variable")), lambda e: e["code"] == F.col("_code"))
    text = F.when(F.col("_code").isNotNull(), F.try_element_at(entries, F.lit(1))["txt"])
    return grouped.select(
        "stay_id",
        "variable",
        "hours",
        F.when(F.col("_code").isNull(), F.col("_num")).otherwise(number(text)).alias("num"),
        F.coalesce(text, F.col("_num").cast("string")).alias("txt"),
    )


def stay_events(
    events: DataFrame, stays: DataFrame, items: DataFrame, categories: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Scope, clean, attribute and de-duplicate raw events."""
    scoped = in_scope(events, stays, items)
    return largest_per_time(attribute(clean_events(scoped, items), stays), categories)


def with_events(stays: DataFrame, events: DataFrame) -> DataFrame:
    """Stays that have at least one measurement."""
    return stays.join(events.select("stay_id"), "stay_id", "left_semi")
