import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolweave.llm import prefix_trie as trie

from .helpers import CLASHES

DDL = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), digest(role, text), role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - int(np.fmod(c, 100)), [])
        whole[c] = (*head[:h], *turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda x: x[:2])


def made(seed, families=4, hot=60):
    rng = random.Random(seed)
    words = ["hi", "Ünï", "", "a b", "日本", "x" * 3000, None]
    rows = []
    for c in [*range(0, 100 * families, 7), *range(0, 100 * families, 100), -5, -300, 10**15 + 7]:
        if c == 200 or rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(words)))
    for c in range(10_000, 10_000 + hot):  # copies of one conversation, and some that go on
        rows += [(c, t, "user", f"hot {t}") for t in range(12 + (c % 9 == 0) * rng.randrange(6))]
    rows += rows[:20] + [(None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("width", [1, 9, 64])
def test_equals_all_prefixes(spark, monkeypatch, width):
    monkeypatch.setattr(trie, "shuffle_width", lambda s: width)
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = made(width)
    df = spark.createDataFrame(rows, DDL)
    for name, value in (CLASHES | {"seq": 1, "token": 2, "head": 3, "h": "h"}).items():
        df = df.withColumn(name, F.lit(value))
    got = rows_of(trie.prefix_nodes(df.repartition(5)))
    assert got == sorted(brute(rows), key=lambda x: x[:2])


def test_shards_share_nodes(spark, monkeypatch):
    """With a shard for every conversation or so, all upper nodes are merged."""
    monkeypatch.setattr(trie, "LEADING", 1)
    monkeypatch.setattr(trie, "shuffle_width", lambda s: 4)
    rows = [(c, t, "u", f"{'same' if t < 40 else c % (t + 1)}") for c in range(1, 90) for t in range(45)]
    got = rows_of(trie.prefix_nodes(spark.createDataFrame(rows, DDL), shard=40))
    assert got == sorted(brute(rows), key=lambda x: x[:2])


def test_empty_and_turnless(spark):
    assert trie.prefix_nodes(spark.createDataFrame([], DDL)).collect() == []
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, None, None, None) for c in turnless]
    assert rows_of(trie.prefix_nodes(spark.createDataFrame(rows, DDL))) == brute(rows)


def test_long_conversation(spark):
    rows = [(100, t, "user", f"turn {t % 97}") for t in range(3000)] + [(101, t, "user", "x") for t in range(4)]
    got = rows_of(trie.prefix_nodes(spark.createDataFrame(rows, DDL)))
    want = brute(rows)
    assert got == sorted(want, key=lambda x: x[:2])


def test_double_array_holds_what_was_added():
    rng = np.random.default_rng(3)
    words = sorted({tuple(rng.integers(0, 40, rng.integers(0, 6))) for _ in range(3000)})
    lengths = np.array([len(w) for w in words])
    codes = np.array([c for w in words for c in w], np.int64)
    t = trie.build(codes, np.cumsum(lengths) - lengths, lengths)
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    assert (t.check != -1).sum() == len(prefixes)
    slots = {(): 0}
    for p in sorted(prefixes, key=len):
        if p:
            slots[p] = int(t.step(np.array([slots[p[:-1]]]), np.array([p[-1]]))[0])
            assert slots[p] >= 0
    assert len(set(slots.values())) == len(prefixes)
    for p in list(prefixes)[:300]:
        for c in range(41):
            assert (int(t.step(np.array([slots[p]]), np.array([c]))[0]) >= 0) == ((*p, c) in prefixes)
