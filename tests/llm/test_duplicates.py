import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from poolweave.llm import components, exact_dedup, golay, simhash

from .helpers import CLASHES, DOCS, documents, prose, union_find

SPACES = re.compile(r"[\x20\x09-\x0D]")
AWKWARD = [
    (1, "a b"), (2, "a  b\n"), (3, None), (4, ""), (5, " \t\v\f\r"), (6, "ab"), (7, "a b"), (8, "x" * 300_000),
    (9, "x " * 300_000), (10, "A b"), (11, "one two"), (12, "ONE two"), (13, "É té"), (14, "ab"),
]


def expected_groups(rows):
    norm = [SPACES.sub("", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [r for r, m in zip(rows, norm) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hashes", [{}, {"hash128": lambda n: F.length(n)}, {"hash128": lambda n: F.length(n), "digest": lambda n: F.lit("same")}])
def test_exact_groups_with_and_without_collisions(spark, hashes):
    rows = AWKWARD + [(100 + i, "cd"[:: 1 - 2 * (i % 2)]) for i in range(6)]
    got = exact_dedup.exact_duplicates(documents(spark, rows, CLASHES), **hashes)
    found = sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    want = expected_groups(rows)
    if "digest" in hashes:
        found, want = ([r[:4] for r in x] for x in (found, want))
    assert found == want


def test_exact_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")]
    got = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in got) == [
        ("1", 3, False), ("1", 3, True), ("2", 1, True), ("None", 1, True), ("None", 3, False),
    ]
    left = exact_dedup.without_exact_duplicates(documents(spark, rows, CLASHES))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "None"]
    assert left.columns == documents(spark, rows, CLASHES).columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.without_near_duplicates(none).count() == 0


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    for flips in ((0,), (3, 9), (22, 0), (11, 12)):
        other = words.copy()
        for f in flips:
            other ^= 1 << f
        a, b = golay.codeword_indices(words), golay.codeword_indices(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))
    counts = (golay.codeword_indices(np.arange(1 << 12)) >= 0).sum(axis=1)
    assert set(counts) == {1, 6}


def test_golay_keys_cover_three_bits():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows, keys = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(60, s) for s in range(6)]
    rows = list(AWKWARD)
    for i in range(120):
        words = base[i % 6].split()
        if i % 5:
            words[i % len(words)] = f"w{i // 7}"
        rows.append((1000 + i, " ".join(words)))
    got = simhash.near_duplicates(documents(spark, rows, CLASHES)).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union_find(pairs, prints)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    left = simhash.without_near_duplicates(documents(spark, rows, CLASHES))
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(set(want.values()))


def test_links_with_large_keys_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(5)
    prints = set()
    for _ in range(4):
        seed = rng.getrandbits(64)
        for _ in range(150):
            p = seed
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(3)
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    want = union_find(pairs, prints)

    def found():
        edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.fingerprint_links(rows).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        return union_find(edges, prints)

    assert found() == want
    # The same keys through the block path: rows of a large key leave in blocks and meet in pairs.
    keys = simhash.golay_keys(np.array(prints, np.uint64).view(np.int64))
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", 16)
    order = np.lexsort([np.array(prints, np.uint64)[keys[0]], keys[1]])
    k, p = keys[1][order], np.array(prints, np.uint64)[keys[0]][order]
    batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 97]), pa.array(p[i : i + 97].view(np.int64))], ["key", "fp"]) for i in range(0, len(k), 97)]
    out = pa.Table.from_batches(simhash._linked(iter(batches))).to_pandas()
    edges = [(a % 2**64, b % 2**64) for a, b in out[out.kind == 0][["a", "b"]].itertuples(index=False)]
    for _, group in out[out.kind == 1].groupby("key"):
        by = {b: x.a.tolist() for b, x in group.groupby("b")}
        for i in by:
            for j in by:
                if i <= j:
                    one = simhash._block_links(pa.table({"a": by[i] + by[j] * (i != j)})).to_pydict()
                    edges += [(a % 2**64, b % 2**64) for a, b in zip(one["a"], one["b"])]
    assert (out.kind == 1).any() and union_find(edges, prints) == want


def test_components_of_paths_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
