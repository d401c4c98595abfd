"""Small document tables with the awkward cases, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
FOLDER = "/root/testdata/sf0.001"


def documents(spark: SparkSession, texts, extra: dict[str, object] | None = None):
    """texts: list of (doc_id, text); extra: more columns with one value each."""
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


def prose(n: int, seed: int = 0, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghéü", k=rng.randint(1, 6))) for _ in range(n))


def union_find(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


CLASHES = {"_row": 7, "fp": "x", "key": 1.5, "kept": None, "a": "b", "component_id": 3, "_pw": 1, "start": "s", "kind": 0, "_letters": 5, "_pw_row": 77, "_spans": 1, "_pw_spans": 2, "_lang": "x", "_pw_lang": "y", "_score": 3}
