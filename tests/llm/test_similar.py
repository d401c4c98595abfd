import random

import numpy as np
import pytest

from poolweave.llm import similar
from poolweave.llm.simhash import shingle_hashes

from .helpers import CLASHES, DOCS, documents, prose, union_find


def changed(words, share, rng):
    """A copy with a share of its words, one at least, replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = "".join(rng.choices("abcdefgh", k=5))
    return out


def jaccard(a, b, words=5):
    x, y = (set(shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def vocabulary_text(n, rng):
    """Prose with frequent words that all texts share."""
    return [rng.choice(("the", "of", "and", "in", "to", "a")) if rng.random() < 0.35 else f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.02])
def test_recall_on_planted_copies(spark, share):
    """Copies with one word (0.0), 1 % and 2 % of the words changed; those of at least 0.8 count."""
    rng = random.Random(int(share * 1000) + 3)
    texts, pairs = [], []
    for i in range(300):
        words = vocabulary_text(rng.choice((80, 150, 400)), rng)
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(words, share, rng)))]
        if jaccard(texts[-1][1], texts[-2][1]) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
    found = {r.doc_id: r.component_id for r in similar.similar_groups(documents(spark, texts)).collect()}
    caught = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 100 and caught >= 0.9 * len(pairs)
    assert all(jaccard(texts[i][1], texts[c][1]) >= 0.8 for i, c in found.items())  # pairs only, so links are direct


@pytest.mark.parametrize("few,block", [(6, 1024), (2, 16)])
def test_groups_equal_those_of_all_pairs_among_close_copies(spark, monkeypatch, few, block):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    texts = []
    for g in range(12):
        words = vocabulary_text(120, rng)
        for _ in range(1 + 3 * g):
            texts.append(" ".join(changed(words, 0.005, rng)))
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8]
    want = union_find(links, [i for i, _ in rows])
    got = {r.doc_id: r.component_id for r in similar.similar_groups(documents(spark, rows, CLASHES).repartition(5)).collect()}
    wrong = sum(got[i] != c for i, c in want.items())
    assert wrong <= 0.02 * len(rows)
    left = similar.without_similar(documents(spark, rows, CLASHES | {"_row": 1, "__row": 2, "fp": b"x"}))
    assert len(left.columns) == len(set(left.columns)) and sorted(r.doc_id for r in left.collect()) == sorted(set(got.values()))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (9, "x " * 100_000), (10, "X " * 100_000)]
    got = similar.similar_groups(documents(spark, rows)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(map(lambda g: sorted(map(str, g)), groups.values())) == [["1", "2", "3"], ["10", "9"], ["4", "5"], ["6"], ["7", "7", "None"]]
    assert similar.similar_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert similar.without_similar(spark.createDataFrame([], DOCS)).count() == 0


def test_prints_and_keys():
    rng = random.Random(1)
    words = vocabulary_text(300, rng)
    a, b = (similar.word_print(" ".join(w)) for w in (words, changed(words, 0.01, rng)))
    far = similar.word_print(prose(300, 5))
    bits = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert bits(a, b) < 30 < 64 < bits(a, far)
    keys = similar.word_keys(np.stack([a, b, far, a]))
    assert (keys[0] == keys[3]).all() and (keys[0] == keys[1]).sum() > 5 > (keys[0] == keys[2]).sum()
    assert similar.word_print(None).tolist() == [0] * similar.LANES == similar.word_print(" ").tolist()


def test_links_behind_nearer_fingerprints(spark):
    """Texts of the same words in another order are nearest by their words, but share no shingles: the
    copy with a word changed, which has such texts too, has to be found behind them."""
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        copy = changed(words, 0.0, rng)
        texts += [words, copy] + [rng.sample(t, len(t)) for t in (words, copy) for _ in range(4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and a // 10 == b // 10 and jaccard(x, y) >= 0.8]
    assert len(links) == 12
    got = {r.doc_id: r.component_id for r in similar.similar_groups(documents(spark, rows)).collect()}
    assert got == union_find(links, [i for i, _ in rows])


def test_a_large_group_that_is_near_but_not_linked_makes_no_pairs(spark, monkeypatch):
    """Copies of one text with 4 % of the words changed are near by their fingerprints and, but for the
    few planted ones, of a similarity below 0.8: nothing that is stored grows with their pairs."""
    kept, before = [], similar.stored

    def watched(df, label):
        out = before(df, label)
        kept.append((label, out.count()))
        return out

    monkeypatch.setattr(similar, "stored", watched)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [changed(base, 0.04, rng) for _ in range(240)]
    texts += [changed(t, 0.0, rng) for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8]
    assert 20 <= len(links) < 100
    got = {r.doc_id: r.component_id for r in similar.similar_groups(documents(spark, rows)).collect()}
    assert got == union_find(links, [i for i, _ in rows])
    assert {label for label, n in kept if n > similar.KEYS * len(rows)} == set()
    assert sum(n for label, n in kept if label == "candidates") < len(rows) * (len(rows) - 1) // 4


def test_cells_give_a_forest():
    import pyarrow as pa

    n = 50
    ids = [*range(n), *range(n)]
    sides, parts = [0] * n + [1] * n, [i if i else n for i in ids]
    prints = [b"\0" * 8 * similar.LANES] * 2 * n
    near = similar._near_parts(pa.table({"side": sides, "part": parts, "fp": prints})).to_pylist()
    assert len(near) == n - 1 and set(union_find([(r["a"], r["b"]) for r in near], range(1, n + 1)).values()) == {1}
    sets = [[10 * (i % 3) + k for k in range(9)] + [100 + i] for i in ids]  # three groups, 9 of 11 shingles alike
    sets[0] = sets[n] = []
    cell = pa.table({"side": sides, "_row": ids, "part": parts, "shingles": pa.array(sets, pa.list_(pa.int64()))})
    found = similar._similar_rows(cell, 0.8).to_pylist()
    assert len(found) == n - 4 and set(union_find([(r["a"], r["b"]) for r in found], range(n)).values()) == {0, 1, 2, 3}
    assert similar._similar_rows(cell, 0.9).num_rows == 0 == similar._similar_rows(cell.slice(n), 0.8).num_rows
