import numpy as np
from pyspark.sql import functions as F

from poolweave.llm import langid

from .helpers import CLASHES, DOCS, documents


def small_network(seed=0, hidden=4, classes=3):
    rng = np.random.default_rng(seed)
    ways = [langid.Direction.random(hidden, classes, rng) for _ in range(2)]
    for w in ways:
        w.inputs, w.states, w.read = (a.astype(np.float64) * 0.3 for a in (w.inputs, w.states, w.read))
    return langid.Network(list("abc")[:classes], *ways, np.zeros(classes))


def test_gradients_equal_differences():
    net = small_network()
    rng = np.random.default_rng(1)
    codes, labels = rng.integers(0, 6, (7, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(codes, labels)
    for p, g in zip(net.parameters(), grads):
        for at in list(np.ndindex(p.shape))[: 40 if p.shape[0] == 256 else None : 3]:
            old, step = p[at], 1e-3
            p[at] = old + step
            high = net.gradients(codes, labels)[0]
            p[at] = old - step
            low = net.gradients(codes, labels)[0]
            p[at] = old
            assert abs((high - low) / (2 * step) - g[at]) < 2e-3


def brute(text: bytes, net):
    """Position by position, the way the docstring says."""
    total = np.zeros(len(net.bias))
    full = len(text) // langid.SPAN * langid.SPAN
    pieces = [(s, 0, langid.SPAN) for s in range(0, full, langid.SPAN)]
    if len(text) % langid.SPAN:
        s = max(0, len(text) - langid.SPAN)
        pieces.append((s, full - s, len(text) - s))
    for s, skip, stop in pieces:
        codes = np.frombuffer(text[s : s + stop], np.uint8)[:, None].astype(int)
        after = {t: net.backward.read @ x for t, x in net.backward.run(codes, None, True)}
        for t, x in net.forward.run(codes, None, False):
            y = (net.forward.read @ x + after[t])[:, 0] + net.bias
            if skip <= t:
                total += np.exp(y) / np.exp(y).sum()
    return total / len(text)


def test_documents_equal_a_walk_over_positions():
    net = small_network(3)
    texts = [b"a", b"hello world", bytes(range(64)), b"xy" * 50, b"q" * 65, b"some longer text " * 20]
    got = langid.label_documents(texts, net, block=2)
    want = np.array([brute(t, net) for t in texts])
    assert np.abs(got - want).max() < 1e-4
    assert np.allclose(got.sum(axis=1), 1, atol=1e-4)


def test_held_out_accuracy_and_undetermined_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = documents(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 $$ \n"), (10**6 + 3, "é")]).withColumn("lang", F.lit(None).cast("string"))
    found = langid.languages(docs.unionByName(odd).withColumn("_pw_score", F.lit(1)), documents=300)
    rows = {r.doc_id: r for r in found.join(docs.select("doc_id", "lang"), "doc_id", "left").collect()}
    assert len(rows) == 1004
    held = [r for r in rows.values() if r.held_out and r.lang is not None]
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[10**6 + i].lang_pred == "und" for i in range(4)] == [True, True, True, False]
    assert langid.languages(spark.createDataFrame([], DOCS)).count() == 0


def test_stage_keeps_columns_and_rejects_only_unknown(spark):
    texts = [(i, "the cat and the dog of this house " * 3) for i in range(12)] + [(20, None), (21, "!!"), (22, "")]
    docs = documents(spark, texts, CLASHES)
    out = langid.with_known_language(docs, documents=10)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(12))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.with_known_language(unlabelled).count() == 12
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}


def many_languages(spark, count):
    """A table with ``count`` values of lang: the last has one document, the others three or more."""
    rows = [(i, "ab cd " * 15, f"x{i % (count - 1):03}") for i in range(4 * (count - 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rare = spark.createDataFrame([(10**6 + i, "語彙 " * 20, "rare") for i in range(5)], docs.schema)
    return docs.unionByName(rare.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).limit(1))


def test_every_language_is_learnt(spark):
    docs = many_languages(spark, 90)
    known = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    want = {r.lang for r in known.select("lang").distinct().collect()}
    assert len(want) > 64 and "rare" in want
    assert set(langid.fit(docs, epochs=1).languages) == want
    assert set(langid.fit(docs, documents=1, epochs=1).languages) == want


def test_the_sample_stays_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "trained", lambda pieces, labels, names, **_: seen.append((len(pieces), len(names))))
    docs = spark.range(4000).selectExpr("id doc_id", "repeat(concat(id, ' words of it '), 60) text", "concat('l', id % 8) lang")
    langid.fit(docs, documents=40, languages=2)
    assert seen[0][1] == 8 and seen[0][0] <= 40 * 2 * langid.STRETCHES
