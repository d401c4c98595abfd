"""Pools, budgets, random selection and the contract every method must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.ranks import take_top
from ..functions.vectors import vector_mean
from . import checks


def candidates(train: DataFrame, labeled: DataFrame, key: str = "id") -> DataFrame:
    return train.join(labeled.select(key), key, "left_anti")


def grown(labeled: DataFrame, queried: DataFrame, key: str = "id") -> DataFrame:
    return labeled.select(key).unionByName(queried.select(key)).distinct()


def random_selection(pool: DataFrame, budget: int, seed: int, round_index: int = 0, key: str = "id") -> DataFrame:
    """``budget`` ids in the order of a seeded hash."""
    drawn = pool.select(key).withColumn("_u", uniform(seed + round_index, "random", key))
    return take_top(drawn, "_u", key, budget, descending=False).select(key, "rank")


def initial_selection(pool: DataFrame, size: int, seed: int, key: str = "id") -> DataFrame:
    """First labeled ids: a seeded draw, reported in id order."""
    drawn = pool.select(key).withColumn("_u", uniform(seed, "initial", key))
    return take_top(drawn, "_u", key, size, descending=False).select(key).orderBy(key)


def pool_overlap(roles: DataFrame, key: str = "id") -> DataFrame:
    """Ids that appear in more than one of the candidate / labeled / reference pools.

    One grouping by id with a role bit mask; pairs are literal masks.
    """
    bit = F.when(F.col("role") == "candidate", 1).when(F.col("role") == "labeled", 2).otherwise(4)
    masks = roles.groupBy(key).agg(F.bit_or(bit).alias("m"))
    has = lambda m: F.count_if(F.col("m").bitwiseAND(F.lit(m)) == m)
    names = ["candidate/labeled", "candidate/reference", "labeled/reference"]
    row = masks.agg(*[has(m).alias(n) for n, m in zip(names, (3, 5, 6))])
    return checks.long_counts(row, names)


def contract_findings(
    selection: DataFrame, pool: DataFrame, labeled: DataFrame, budget: int, key: str = "id"
) -> DataFrame:
    """Exact budget, unique ids and ranks, inside the pool, none labeled already."""
    sizes = selection.agg(
        F.abs(F.count("*") - F.lit(budget)).alias("budget differs"),
        (F.count("*") - F.countDistinct(key)).alias("id selected twice"),
        (F.count("*") - F.countDistinct("rank")).alias("rank used twice"),
    )
    outside = selection.join(pool.select(key), key, "left_anti").agg(F.count("*").alias("violations"))
    again = selection.join(labeled.select(key), key, "left_semi").agg(F.count("*").alias("violations"))
    return checks.union_all(
        [
            checks.long_counts(sizes, ["budget differs", "id selected twice", "rank used twice"]),
            outside.select(F.lit("id outside the pool").alias("check"), "violations"),
            again.select(F.lit("id already labeled").alias("check"), "violations"),
        ]
    )


def score_summary(scores: DataFrame, selection: DataFrame, parts: list[str], key: str = "id") -> DataFrame:
    """Pool mean and selected mean of each score component."""
    marked = scores.join(selection.select(key, F.lit(True).alias("_s")), key, "left")
    row = marked.agg(
        *[F.avg(p).alias(f"{p}_pool") for p in parts],
        *[F.avg(F.when(F.col("_s"), F.col(p))).alias(f"{p}_sel") for p in parts],
    )
    triples = F.array(
        *[
            F.struct(
                F.lit(p).alias("component"),
                F.col(f"{p}_pool").alias("pool_mean"),
                F.col(f"{p}_sel").alias("selected_mean"),
            )
            for p in parts
        ]
    )
    return row.select(F.explode(triples).alias("t")).select("t.*")


def order_findings(rows: DataFrame, requested: DataFrame, key: str = "group_id") -> DataFrame:
    """Requested group ids are unique and equal to the groups present."""
    present = rows.select(key).distinct()
    miss = requested.select(key).join(present, key, "left_anti").agg(F.count("*").alias("violations"))
    extra = present.join(requested.select(key), key, "left_anti").agg(F.count("*").alias("violations"))
    return checks.union_all(
        [
            checks.duplicate_count(requested, [key], "group requested twice"),
            miss.select(F.lit("requested group without rows").alias("check"), "violations"),
            extra.select(F.lit("group not requested").alias("check"), "violations"),
        ]
    )


def group_outputs(rows: DataFrame, key: str = "group_id", fuser=None) -> DataFrame:
    """Item outputs to group outputs: mean token per modality, union of labels, counts.

    Means are JVM vector aggregates with map-side partial sums, so a group that holds a
    third of all rows is reduced before the shuffle. With a fuser the group's features
    and probabilities are computed once from its mean tokens.
    """
    width = F.size("y")
    tokens = rows.select(key, F.posexplode("tokens").alias("modality", "vec"))
    means = tokens.groupBy(key, "modality").agg(vector_mean("vec").alias("vec"))
    packed = means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("modality", "vec"))), lambda t: t["vec"]).alias("tokens")
    )
    hits = rows.select(key, F.posexplode("y").alias("ord", "v")).groupBy(key, "ord").agg(F.max("v").alias("v"))
    labels = hits.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", F.least(F.greatest("v", F.lit(0)), F.lit(1)).alias("v")))),
            lambda t: t["v"],
        ).alias("y")
    )
    counts = rows.groupBy(key).agg(F.count("*").alias("items"), F.max(width).alias("_w"))
    out = packed.join(labels, key).join(counts.drop("_w"), key)
    if fuser is None:
        return out
    return with_fused(out, fuser)


def with_fused(rows: DataFrame, fuser) -> DataFrame:
    """Attach fused features and probabilities of the token column."""
    from ..functions.vectors import add_columns

    def run(tokens):
        fused = fuser.fuse(tokens)
        return {"features": fused, "p": fuser.probabilities(fused)}

    return add_columns(rows, ["tokens"], "features array<double>, p array<double>", run)
