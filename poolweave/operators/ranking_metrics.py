"""Ranking metrics over long predictions (id, label, ord, y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import join_on, range_bounds, range_of
from ..session import cut_lineage
from . import checks


def label_ranks(cells: DataFrame) -> DataFrame:
    """Rank of each label inside its row by descending score, ties by label order.

    A row's labels are bounded by the label dimension, so this is an array operation
    after one grouping by id; no window sort is needed.
    """
    packed = cells.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("k"), "ord", "label", "y", "p"))).alias("r")
    )
    return packed.select("id", F.posexplode("r").alias("pos", "c")).select(
        "id", "c.label", "c.ord", "c.y", "c.p", (F.col("pos") + 1).cast("bigint").alias("label_rank")
    )


def recall_rows(cells: DataFrame, ks: list[int]) -> DataFrame:
    """Per id: positives and hits in the top k for every k."""
    packed = cells.groupBy("id").agg(
        F.sum("y").cast("double").alias("positives"),
        F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("k"), "ord", F.col("y").cast("int").alias("y")))).alias("r"),
    )
    hit = lambda k: F.aggregate(
        F.slice("r", 1, k), F.lit(0), lambda a, x: a + x["y"]
    ).cast("double")
    return packed.select("id", "positives", *[hit(k).alias(f"hits_{k}") for k in ks])


def top_labels(cells: DataFrame, k: int) -> DataFrame:
    """The k best labels of each id as rows."""
    return label_ranks(cells).filter(F.col("label_rank") <= k).select("id", "label", "label_rank")


def recall_at(cells: DataFrame, ks: list[int], on_empty: str = "error") -> DataFrame:
    """(k, recall): mean over ids of hits / positives. Ids without positives raise or drop."""
    rows = recall_rows(cells, ks)
    if on_empty == "error":
        bad = F.raise_error(F.lit("top-k recall is undefined for rows without positive labels")).cast("double")
        positives = F.when(F.col("positives") > 0, F.col("positives")).otherwise(bad)
    elif on_empty == "drop":
        rows = rows.filter(F.col("positives") > 0)
        positives = F.col("positives")
    else:
        raise ValueError("on_empty is 'error' or 'drop'")
    means = rows.agg(*[F.avg(F.col(f"hits_{k}") / positives).alias(f"r{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])
    return means.select(F.explode(pairs).alias("p")).select("p.k", "p.recall")


def prior_recall(train_positives: DataFrame, test_positives: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """Recall@k of the constant ranking by train frequency, on test ids with positives."""
    counts = train_positives.groupBy("label").agg(F.count("*").alias("_n"))
    top = (
        names.select("label", "ord")
        .join(counts, "label", "left")
        .orderBy(F.desc(F.coalesce("_n", F.lit(0))), F.asc("ord"))
        .limit(k)
        .select("label", F.lit(1).alias("_top"))
    )
    rows = test_positives.join(F.broadcast(top), "label", "left").groupBy("id").agg(
        (F.coalesce(F.sum("_top"), F.lit(0)) / F.count("*")).alias("r")
    )
    return rows.agg(F.avg("r").alias("prior_recall"))


def score_table(cells: DataFrame) -> tuple[DataFrame, list[float]]:
    """(label, p, pos, neg) stored once, with the range bounds of the scores."""
    counts = cut_lineage(
        cells.groupBy("label", (F.col("p").cast("double") + F.lit(0.0)).alias("p")).agg(
            F.sum(F.col("y").cast("bigint")).alias("pos"),
            F.sum((F.lit(1) - F.col("y")).cast("bigint")).alias("neg"),
        )
    )
    return counts, range_bounds(counts, "p")


# Range totals up to this many rows (labels x ranges) are sent to every task; more are joined.
TOTALS_LIMIT = 100_000


def _placed(counts: DataFrame, bounds: list[float]) -> DataFrame:
    """Every (label, p) with the counts at this score or a greater one, of its label and of all (``m_``).

    A range is shuffled once and sorted twice inside its task; the scores of a label are distinct by
    then, so a range is as many rows as the bounds say.
    """
    counts = counts.withColumn("_range", range_of(F.col("p"), bounds))
    totals = cut_lineage(counts.groupBy("label", "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    few = totals.count() <= TOTALS_LIMIT
    ahead = totals.select("label", "_range")
    for keys, m in ((["label"], ""), ([], "m_")):
        whole = Window.partitionBy(*keys)
        # One row per label and range at most; without a label one row per range.
        flat = totals.groupBy(*keys, "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        greater = whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        flat = flat.select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(c).over(greater), F.lit(0)).alias(f"_{m}{c}_ahead") for c in ("pos", "neg")],
            *[F.sum(c).over(whole).alias(f"{m}{c}_all") for c in ("pos", "neg")],
        )
        ahead = join_on(ahead, F.broadcast(flat) if few else flat, [*keys, "_range"])
    rows = join_on(counts.repartition("_range"), F.broadcast(ahead) if few else ahead, ["label", "_range"])
    inside = {
        "": Window.partitionBy("_range", "label").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow),
        "m_": Window.partitionBy("_range").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow),
    }
    for m, window in inside.items():
        rows = rows.select("*", *[(F.col(f"_{m}{c}_ahead") + F.sum(c).over(window)).alias(f"{m}{c}_from") for c in ("pos", "neg")])
    return rows


def _sums(m: str = "") -> list[Column]:
    """Aggregates for average precision and for pairs in order, ties half: the positives from a negative's
    score upwards and the negatives below a positive's count every pair twice, and a tie once."""
    from_pos, from_neg = F.col(f"{m}pos_from"), F.col(f"{m}neg_from")
    ap = F.sum(F.try_divide(F.col("pos"), F.col(f"{m}pos_all")) * from_pos / (from_pos + from_neg))
    wins = F.sum((F.col("neg") * from_pos + F.col("pos") * (F.col(f"{m}neg_all") - from_neg)) / F.lit(2.0))
    return [
        F.max(f"{m}pos_all").alias(f"{m}positives"),
        F.max(f"{m}neg_all").alias(f"{m}negatives"),
        ap.alias(f"{m}ap"),
        wins.alias(f"{m}wins"),
    ]


def _rates(m: str = "") -> list[Column]:
    """AUROC by tie-averaged ranks and average precision over distinct scores, NULL if undefined."""
    pairs = F.col(f"{m}positives") * F.col(f"{m}negatives")
    return [
        F.when(F.col(f"{m}positives") > 0, F.col(f"{m}ap")).alias("micro_auprc" if m else "auprc"),
        F.when(pairs > 0, F.col(f"{m}wins") / pairs).alias("micro_auroc" if m else "auroc"),
    ]


def label_areas(cells: DataFrame) -> DataFrame:
    """Per label: positives, negatives, average precision and AUROC (NULL if undefined)."""
    return areas_of(*score_table(cells))


def areas_of(counts: DataFrame, bounds: list[float]) -> DataFrame:
    """The areas of a stored score table."""
    return _placed(counts, bounds).groupBy("label").agg(*_sums()).select("label", "positives", "negatives", *_rates())


def ranking_metrics(cells: DataFrame, strict: bool = True) -> DataFrame:
    """One row: macro and micro AUPRC and AUROC with the label coverage."""
    per_label = _placed(*score_table(cells)).groupBy("label").agg(*_sums(), *_sums("m_"))
    over_all = [F.max("m_positives"), F.max("m_negatives"), F.sum("m_ap"), F.sum("m_wins")]
    out = per_label.select("*", *_rates()).agg(
        F.avg("auprc").alias("macro_auprc"),
        F.avg("auroc").alias("macro_auroc"),
        F.count("*").alias("labels"),
        F.count("auprc").alias("labels_auprc"),
        F.count("auroc").alias("labels_auroc"),
        *[c.alias(n) for c, n in zip(over_all, ("m_positives", "m_negatives", "m_ap", "m_wins"))],
    )
    out = out.select("macro_auprc", "macro_auroc", "labels", "labels_auprc", "labels_auroc", *_rates("m_"))
    if strict:
        bad = F.raise_error(F.lit("AUPRC or AUROC is undefined for every label")).cast("double")
        for c in ("macro_auprc", "macro_auroc"):
            out = out.withColumn(c, F.coalesce(c, bad))
    return out


# The metrics each task family reports.
TASK_METRICS = {
    "diagnoses": ["recall_at_10", "recall_at_20", "recall_at_30", "macro_auprc", "macro_auroc"],
    "phenotyping": ["macro_auprc", "micro_auprc", "macro_auroc", "micro_auroc"],
}


def task_metrics(cells: DataFrame, task: str) -> DataFrame:
    """(metric, value) rows of the metric set of a task."""
    if task not in TASK_METRICS:
        raise checks.AuditError(f"unknown task {task!r}")
    wanted = TASK_METRICS[task]
    ks = [int(m.rsplit("_", 1)[1]) for m in wanted if m.startswith("recall_at_")]
    if ks:
        cells = cut_lineage(cells.select("id", "label", "ord", "y", "p"))  # read by both kinds of metrics
    row = ranking_metrics(cells)
    names = [m for m in wanted if not m.startswith("recall_at_")]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    out = row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
    if ks:
        recall = recall_at(cells, ks).select(
            F.concat(F.lit("recall_at_"), F.col("k").cast("string")).alias("metric"),
            F.col("recall").alias("value"),
        )
        out = recall.unionByName(out)
    return out


def masked_loss(cells: DataFrame) -> DataFrame:
    """Mean binary cross-entropy over cells with a label."""
    return cross_entropy(cells.filter(F.col("y").isNotNull()))


def cross_entropy(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Mean binary cross-entropy over all (item, label) cells."""
    p = F.greatest(F.least(F.col("p"), F.lit(1.0 - eps)), F.lit(eps))
    loss = -(F.col("y") * F.log(p) + (F.lit(1.0) - F.col("y")) * F.log(F.lit(1.0) - p))
    return cells.agg(F.count("*").alias("cells"), F.avg(loss).alias("loss"))


def unit_histogram(values: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts over equal bins of [0, 1]; the last bin is closed."""
    index = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return (
        values.filter(F.col(column).between(0.0, 1.0))
        .groupBy(index.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
