import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from poolweave.llm import suffix_dedup

from .helpers import CLASHES, DOCS, documents, prose


def brute(rows, length=200):
    places = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for s in range(len(t) - length + 1):
            places[t[s : s + length]] += 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if places[t[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    passages = [prose(80, 100 + i) for i in range(5)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 900), (5, "ab" * 150), (6, "ü" * 100), (7, "ü" * 99 + "ab"), (8, "y" * 200)]
    for i in range(60):
        parts = [prose(rng.randint(0, 60), i)]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(passages)
            a = rng.randint(0, 150)
            parts += [text[a : a + rng.randint(150, 320)], prose(rng.randint(0, 20), 1000 + rng.randint(0, 30))]
        rows.append((10 + i, "".join(parts)))
    rows += [(200, rows[20][1]), (201, rows[21][1][:-3] + "zzz"), (202, "q" + rows[22][1])]
    # One string of exactly 200 bytes, and one of 199, with other neighbours each time.
    rows += [(300 + i, prose(30, 500 + i) + passages[0][:200] + prose(30, 600 + i)) for i in range(3)]
    rows += [(310 + i, prose(30, 700 + i) + "!" + prose(90, 9)[:199] + "?*"[i] + prose(30, 800 + i)) for i in range(2)]
    return rows


@pytest.mark.parametrize("group", [100_000, 5])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = corpus()
    got = suffix_dedup.repeated_strings(documents(spark, rows, CLASHES).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_repeated_ids_are_separate_texts_and_stage_keeps_columns(spark):
    a, b = prose(70, 1), prose(70, 2)
    rows = [(1, a), (1, a), (None, b), (2, b + "é"), (3, None)]
    got = suffix_dedup.repeated_strings(documents(spark, rows))
    assert sorted(map(str, (r.n_removed for r in got.collect()))) == sorted(map(str, (r[2] for r in brute(rows))))
    docs = documents(spark, rows, CLASHES)
    out = suffix_dedup.without_repeated_strings(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["", "", "", "é", "None"])
    assert suffix_dedup.repeated_strings(spark.createDataFrame([], DOCS)).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = (prose(3000, 4) + "ab" * 300 + prose(500, 5)).encode()
    whole = {(int(p), int(g), int(c)) for p, g, c in zip(*suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([len(text)])))}
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    parts = {(int(p), int(g), int(c)) for _, at, gram, con in suffix_dedup._text_anchors([text]) for p, g, c in zip(at, gram, con)}
    assert parts == whole


def test_every_string_has_an_anchor():
    for text in (prose(800, 8).encode(), b"a" * 1000, b"abc" * 300):
        at = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))[0]
        for s in range(len(text) - 199):
            assert ((at >= s) & (at <= s + 168)).any()


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(0)
    group = rng.integers(0, 4, 500)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_order(group, words)
    rows = [(group[i], *words[i]) for i in order]
    assert rows == sorted(rows)


def test_ranges_with_open_ends():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)], ["gram", "context", "_row", "pos"])

    rows = [(1, 1, 1, 0), (1, 2, 2, 0), (2, 5, 3, 0), (2, 5, 4, 0), (2, 6, 5, 0), (3, 1, 6, 0), (4, 1, 7, 0), (4, 1, 8, 0), (5, 1, 9, 0)]
    got = pa.Table.from_batches(suffix_dedup._compared(iter([batch(rows[:4]), batch(rows[4:])]))).to_pylist()
    kinds = sorted((r["_row"], r["kind"]) for r in got)
    assert kinds == [(1, 5), (2, 1), (3, 0), (3, 2), (4, 0), (5, 1), (7, 0), (8, 0), (9, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_into_ranges_gives_the_same_kinds(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(1, 6), rng.randint(1, 3 + seed), i, 0) for i in range(40))
    schema = "gram long, context long, _row long, pos long"

    def kinds(cuts):
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            if b > a:
                cols = [pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in range(4)]
                part = pa.RecordBatch.from_arrays(cols, ["gram", "context", "_row", "pos"])
                out += pa.Table.from_batches(suffix_dedup._compared(iter([part]))).to_pylist()
        ends = [tuple(r.values()) for r in out if r["kind"] >= suffix_dedup.OPEN]
        closed = suffix_dedup._closed(spark.createDataFrame(ends, schema + ", kind int")).collect()
        both = [(r["gram"], r["context"], r["_row"], r["kind"]) for r in out if r["kind"] < suffix_dedup.OPEN]
        both += [(r.gram, r.context, r._row, r.kind) for r in closed]
        return sorted((g, c, k, r if k != suffix_dedup.MODEL else None) for g, c, r, k in both)

    whole = kinds([])
    assert len(whole) == len({*whole}) and kinds(sorted(rng.sample(range(40), 12))) == whole
