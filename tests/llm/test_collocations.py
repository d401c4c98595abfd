import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from poolweave.llm import collocations as col

from .helpers import CLASHES, documents

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, share, best):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            longer = [f[q] for q in f if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and f[q] >= least]
            if any(100 * x >= share * a for x in longer):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least,share,best,width", [(2, 50, 2000, 8), (3, 80, 7, 40), (2, 100, 2000, 3)])
def test_equals_counting_everything(spark, monkeypatch, least, share, best, width):
    monkeypatch.setattr(col, "shuffle_width", lambda s: width)
    words = ["Der", "a", "b", "ü", "Ü", "c\x0bd", "x.y", "日", "a,", "b;", "the"]
    rng = random.Random(least)
    texts = [(rng.choice([None, "und", "en", "de"]), rng.choice([" ", "\t ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(60)]
    texts += [("en", None), (None, ""), ("en", "hot pair " * 400), ("en", "hot pair of " * 300), ("fr", "a b"), ("en", texts[0][1]), ("en", texts[0][1])]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    for name, value in (CLASHES | {"n": 3, "rank": 1, "phrase": "p", "words": 2, "slot": 1}).items():
        df = df.withColumn(name, F.lit(value))
    assert rows_of(col.collocations(df.repartition(5), least, share, best)) == brute(texts, least, share, best)


def test_empty_table(spark):
    assert col.collocations(documents(spark, [])).collect() == []


def test_products_beyond_64_bits():
    a = 3 * 10**11
    assert col.lowest(a, [(a, 4 * a)]) == (250_000, a, 4 * a)
    assert col.lowest(6, [(6, 6), (6, 6)]) == (1_000_000, 6, 6)


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(col, "CHUNK", 200)
    text = "one two three four. " * 100 + "no end here " * 100
    df = documents(spark, [(1, text), (2, "one two three")]).withColumn("lang", F.lit("en"))
    assert rows_of(col.collocations(df, 10, 50, 2000)) == brute([("en", text), ("en", "one two three")], 10, 50, 2000)


def test_filter_only_saves_work(spark, monkeypatch):
    """Where the filter lets everything through, nothing changes."""
    texts = [("en", "a b c a b d. " * 12), ("de", "x y z " * 11)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    want = brute(texts, 10, 50, 2000)
    monkeypatch.setattr(col, "_passes", lambda bits, hashes: hashes == hashes)
    assert rows_of(col.collocations(df)) == want
