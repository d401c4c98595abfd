import math

import numpy as np
import pytest

from poolweave.llm import bitslice

from .helpers import FOLDER

SCHEMA = "vec_id long, embedding array<float>, label int, block string, v int"


def brute(rows, k, every):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for i, v in sorted(whole, key=lambda r: (r[0], len(r[1]), r[1])):
        if i % every or i in done:
            continue
        done.add(i)
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows,queries", [(16384, 256), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(bitslice, "ROWS", rows)
    monkeypatch.setattr(bitslice, "QUERIES", queries)
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 0.13, 16).tolist()) for i in range(300)]
    data += [(300 + i, data[i % 7][1]) for i in range(40)] + [(400 + i, [0.0] * 16) for i in range(10)]
    data += [(500, None), (510, [None] * 16), (520, [float("nan")] * 16), (530, [float("inf")] * 16), (None, data[0][1])]
    data += [(600, [1.0, 2.0]), (601, [3.0, -2.0]), (610, [5.0] * 3), (620, []), (621, []), (0, data[5][1]), (1, data[5][1])]
    data += [(700 + i, (100 * rng.normal(0, 1, 16)).tolist()) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, "b", 3) for i, v in data], SCHEMA).repartition(5)
    got = bitslice.nearest(df, k=5, every=10)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5, 10)
    assert bitslice.nearest(df.filter("false")).count() == 0


def test_components_of_any_size(spark):
    """From 2^15 over 2^31, 2^53 and 2^63 up to the largest doubles, against exact integers."""
    from fractions import Fraction

    rng = np.random.default_rng(4)
    sizes = [1.0, 300.0, 1e7, 1e12, 1e17, 1e300, 1.7e308]
    data = [(i, (rng.normal(0, 1, 3) * rng.choice(sizes[: 1 + i % 7], 3)).clip(-1.79e308, 1.79e308).tolist()) for i in range(140)]
    data += [(150, [1e7, 1.0, 0.0]), (151, [2.0, 1.0, 0.0]), (152, [3.0, 1.0, 0.0]), (200, [1e300, -1e300, 5.0]), (201, [1e300, -1e300, 5.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in data}
    want = []
    for i in whole:
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[i], w)), j) for j, w in whole.items() if j != i)
            want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in bitslice.nearest(df, k=5, every=10).collect()) == sorted(want)


def test_slices_give_the_weighted_sums():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 500):
        values = rng.integers(-90, 90, (n, 8))
        block = bitslice.SlicedBlock(np.arange(n), values)
        codes = (values - block.low) >> block.cut
        weights = rng.integers(0, 130, 8)
        planes = block.sums(weights)
        bits = np.stack([np.unpackbits(p.view(np.uint8), bitorder="little")[:n] for p in planes]).astype(np.int64)
        sums = (bits << np.arange(len(planes))[:, None]).sum(axis=0)
        assert sums.tolist() == (codes @ weights).tolist()
        for k in (1, n // 2 + 1, n):
            kth = block._kth(planes, k)
            assert kth == sorted(sums)[::-1][k - 1]
            assert set(block._at_least(planes, kth)) == set(np.flatnonzero(sums >= kth))
        query = rng.integers(-90, 90, 8)
        for k in (1, 5, 20):
            ids, scores = block.best(query, -1, k)
            order = np.lexsort([np.arange(n), -(values @ query)])[:k]
            assert ids.tolist() == order.tolist()


def test_slices_leave_few_rows_to_score():
    rng = np.random.default_rng(3)
    values = np.floor(256 * rng.normal(0, 0.125, (16384, 64))).astype(np.int64)
    block = bitslice.SlicedBlock(np.arange(len(values)), values)
    assert max(len(block.candidates(values[i], 5)) for i in range(20)) < 2000
