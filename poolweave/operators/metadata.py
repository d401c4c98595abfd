"""Item metadata of groups: train-only schema and its vector projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import category_text, locale_number, token_list
from . import checks

# The first two entries of every vocabulary.
MISSING, UNKNOWN = "<missing>", "<unknown>"


@dataclass(frozen=True)
class MetaFields:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    folded: tuple[str, ...] = ()
    tokens: str | None = None


@dataclass
class MetaSchema:
    stats: dict[str, tuple[float, float]]
    vocab: dict[str, list[str]]
    tokens: list[str]


def numeric_stats(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Mean and population std of observed numbers per field; a zero std becomes 1."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), locale_number(F.col(f).cast("string")).alias("v")) for f in fields]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.v")
        .filter(F.col("v").isNotNull())
        .groupBy("field")
        .agg(
            F.avg("v").alias("mean"),
            F.coalesce(F.nullif(F.stddev_pop("v"), F.lit(0.0)), F.lit(1.0)).alias("std"),
        )
    )


def vocabularies(df: DataFrame, fields: tuple[str, ...], folded: tuple[str, ...] = ()) -> DataFrame:
    """(field, value, ord): missing and unknown tokens first, then the sorted values."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), category_text(F.col(f), f in folded).alias("value"))
            for f in fields
        ]
    )
    seen = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.value")
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
    )
    ordered = seen.withColumn(
        "ord", (F.row_number().over(Window.partitionBy("field").orderBy("value")) + 1).cast("int")
    )
    heads = seen.select("field").distinct().select(
        "field",
        F.explode(
            F.array(
                F.struct(F.lit(MISSING).alias("value"), F.lit(0).alias("ord")),
                F.struct(F.lit(UNKNOWN).alias("value"), F.lit(1).alias("ord")),
            )
        ).alias("h"),
    )
    return heads.select("field", "h.value", "h.ord").unionByName(ordered)


def token_vocabulary(df: DataFrame, column: str, minimum: int) -> DataFrame:
    """Tokens of a comma list carried by at least ``minimum`` rows."""
    tokens = df.select(F.explode(token_list(F.col(column))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)


def fit_metadata(train: DataFrame, fields: MetaFields, minimum_tokens: int = 10) -> MetaSchema:
    """Collect the fitted dimensions: one row per field, vocabulary value and token."""
    stats = {r["field"]: (r["mean"], r["std"]) for r in numeric_stats(train, fields.numeric).collect()}
    missing = [f for f in fields.numeric if f not in stats]
    if missing:
        raise checks.AuditError(f"no observed values for {missing}")
    vocab: dict[str, list[str]] = {f: [MISSING, UNKNOWN] for f in fields.categorical}
    for r in vocabularies(train, fields.categorical, fields.folded).orderBy("field", "ord").collect():
        if r["ord"] > 1:
            vocab[r["field"]].append(r["value"])
    tokens: list[str] = []
    if fields.tokens:
        tokens = sorted(r["token"] for r in token_vocabulary(train, fields.tokens, minimum_tokens).collect())
    return MetaSchema(stats, vocab, tokens)


def vector_names(fields: MetaFields, schema: MetaSchema) -> list[str]:
    names: list[str] = []
    for f in fields.numeric:
        names += [f, f"{f}:missing"]
    for f in fields.categorical:
        names += [f"{f}={v}" for v in schema.vocab[f]]
    return names + ["(no token)"] + [f"token={t}" for t in schema.tokens]


def vectorize(df: DataFrame, fields: MetaFields, schema: MetaSchema, out: str = "meta") -> DataFrame:
    """z-score + missing flag, one-hot with unknown, no-token flag, token indicators."""
    parts: list[Column] = []
    for f in fields.numeric:
        mean, std = schema.stats[f]
        value = locale_number(F.col(f).cast("string"))
        parts.append(F.coalesce((value - F.lit(mean)) / F.lit(std), F.lit(0.0)))
        parts.append(value.isNull().cast("double"))
    for f in fields.categorical:
        text = category_text(F.col(f), f in fields.folded)
        known = schema.vocab[f]
        category = (
            F.when(text.isNull() | (text == ""), F.lit(MISSING))
            .when(text.isin(known), text)
            .otherwise(F.lit(UNKNOWN))
        )
        parts.extend((category == v).cast("double") for v in known)
    tokens = token_list(F.col(fields.tokens)) if fields.tokens else F.array().cast("array<string>")
    parts.append((F.size(tokens) == 0).cast("double"))
    parts.extend(F.array_contains(tokens, t).cast("double") for t in schema.tokens)
    return df.withColumn(out, F.transform(F.array(*parts), lambda x: x.cast("float")))


def group_targets(items: DataFrame, labels: list[str], key: str = "group_id") -> DataFrame:
    """Group label = OR over its items."""
    return items.groupBy(key).agg(*[F.max(c).alias(c) for c in labels])


def targets_of(items: DataFrame, wanted: DataFrame, labels: list[str], key: str = "group_id") -> DataFrame:
    return group_targets(items.join(wanted.select(key), key, "left_semi"), labels, key)


def items_of(items: DataFrame, wanted: DataFrame, key: str = "group_id") -> DataFrame:
    """Expand selected groups to their rows."""
    return items.join(wanted.select(key), key, "left_semi")


def group_sizes(items: DataFrame, key: str = "group_id") -> DataFrame:
    """Count of counts: how many groups have each number of items."""
    per = items.groupBy(key).agg(F.count("*").alias("items"))
    return per.groupBy("items").agg(F.count("*").alias("groups"))


def label_load(items: DataFrame, labels: list[str]) -> DataFrame:
    """Rows without a label and rows with several."""
    total = sum((F.col(c).cast("int") for c in labels), F.lit(0))
    return items.agg(
        F.count("*").alias("rows"),
        F.count_if(total == 0).alias("zero_label"),
        F.count_if(total > 1).alias("multi_label"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: the count, and xor and sum of 52-bit row hashes. A row's
    hash is the head of the md5 of its values as text, in the order of the column names, ``~`` for
    NULL, so other engines can recompute it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)]
    digest = F.md5(F.concat_ws("|", *values).cast("binary"))
    h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias("total"),
    )


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with the side they are on."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    return (
        a.join(b, key, "full_outer")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(key, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))
    )
