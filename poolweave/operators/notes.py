"""Notes: usable rows, latest per variable, chronological text, first-note offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_tokens, clean_note, hours_between, variable_name

# Note categories as the source spells them (three end in a blank).
USED_CATEGORIES = [
    "Echo",
    "ECG",
    "Nursing",
    "Physician ",
    "Rehab Services",
    "Case Management ",
    "Respiratory ",
    "Nutrition",
    "General",
    "Social Work",
    "Pharmacy",
    "Consult",
    "Radiology",
    "Nursing/other",
]
DISCHARGE_CATEGORY = "Discharge summary"


def usable(notes: DataFrame) -> DataFrame:
    return notes.filter(F.col("iserror").isNull() & F.col("charttime").isNotNull())


def on_stays(notes: DataFrame, stays: DataFrame) -> DataFrame:
    """Notes joined to the stays of their admission with hours since admission."""
    keys = stays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    return notes.join(keys, ["subject_id", "hadm_id"]).withColumn(
        "hours", hours_between("charttime", "intime")
    )


def first_offsets(notes: DataFrame, stays: DataFrame) -> DataFrame:
    """Hours to each stay's first non-negative note."""
    timed = on_stays(usable(notes).select("subject_id", "hadm_id", "charttime"), stays)
    return (
        timed.filter(F.col("hours") >= 0)
        .groupBy("stay_id")
        .agg(F.min("hours").alias("first_note_hours"))
    )


def latest_per_variable(notes: DataFrame, stays: DataFrame, duration: float, max_chars: int | None = None) -> DataFrame:
    """Latest note per (stay, category/description) inside the window.

    Equal times keep the lowest source row. The choice is made on (hours, source_row) alone, as a
    partial aggregate; the text of the chosen notes is joined by source_row and cleaned then.
    """
    timed = on_stays(usable(notes), stays).filter(
        (F.col("hours") >= 0) & (F.col("hours") <= duration)
    )
    timed = timed.withColumn("variable", variable_name(F.col("category"), F.col("description")))
    picked = timed.groupBy("stay_id", "variable").agg(
        F.max(F.struct(F.col("hours"), (-F.col("source_row")).alias("before"))).alias("p")
    )
    picked = picked.select("stay_id", "variable", "p.hours", (-F.col("p.before")).alias("source_row"))
    body = clean_note(F.coalesce("text", F.lit(" ")))
    return picked.join(notes.select("source_row", "text"), "source_row").select(
        "stay_id",
        "variable",
        "hours",
        "source_row",
        (F.substring(body, 1, max_chars) if max_chars else body).alias("body"),
    )


def in_stay_or_discharge(
    categories: list[str] = USED_CATEGORIES, discharge: str = DISCHARGE_CATEGORY
) -> Column:
    inside = (F.col("charttime") >= F.col("intime")) & (F.col("charttime") <= F.col("outtime"))
    return (F.col("category").isin(categories) & inside) | (F.col("category") == discharge)


def chronological(
    notes: DataFrame,
    stays: DataFrame,
    categories: list[str] = USED_CATEGORIES,
    discharge: str = DISCHARGE_CATEGORY,
    max_chars: int | None = None,
    keep_untimed: bool = False,
) -> DataFrame:
    """All notes of a stay that count, cleaned, with the keys that order them."""
    rows = notes.filter(F.col("iserror").isNull()) if keep_untimed else usable(notes)
    kept = on_stays(rows, stays).filter(F.coalesce(in_stay_or_discharge(categories, discharge), F.lit(False)))
    body = clean_note(F.coalesce("text", F.lit(" ")))
    return kept.select(
        "stay_id",
        "charttime",
        "source_row",
        (F.substring(body, 1, max_chars) if max_chars else body).alias("body"),
    )


def joined_text(notes: DataFrame, *order: str) -> DataFrame:
    """One text per stay: bodies joined by newlines in the given order.

    The result row of a stay is its whole text, so a stay's notes meet in one row by
    definition of the output; nothing beyond the (order, body) pairs is shipped.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, "body")))
    return notes.groupBy("stay_id").agg(
        F.concat_ws("\n", F.transform(parts, lambda p: p["body"])).alias("text")
    )


def attach_notes(items: DataFrame, notes: DataFrame, length: int) -> DataFrame:
    """Left join of token arrays; gaps get blank tokens and notes_available = false."""
    joined = items.join(notes, "stay_id", "left").withColumn(
        "notes_available", F.col("input_ids").isNotNull()
    )
    for name, blank in blank_tokens(length).items():
        joined = joined.withColumn(name, F.coalesce(name, blank))
    return joined
