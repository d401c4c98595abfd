import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from poolweave.llm import bitplane, packing, tokens

from .helpers import CLASHES, DOCS, FOLDER, documents, prose

PATH = tokens.default_path()
ODD = [
    None, "", " ", "  ", "a  b", "a b ", " a", "\n", "a \n b", "it's we'll 12 34", "x" * 5000, "tab\tx y", "é ü ß",
    "a  b", "\x1c y", "<|endoftext|> z", "日本 語。 x", "a b\n", "...!? ok", "é e",
]


def direct(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_word_tokenizer_equals_the_library(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    got = tokens.WordTokenizer(PATH).encode(texts)
    assert [x.tolist() for x in got] == direct(texts)


def test_added_tokens_are_the_library_s():
    """The reference is the library with add_special_tokens=False and nothing else set."""
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b one\ntwo", "one <|endoftext|", "one two"]
    library = Tokenizer.from_file(PATH)
    got = [x.tolist() for x in tokens.WordTokenizer(PATH).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [87, 220, 50256, 331]


def test_word_tokenizer_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    t = tokens.WordTokenizer(PATH)
    for text in ("one two three four five six seven", "one two eight\nnine ten", "nine " + "x" * 60, "eleven"):
        assert [x.tolist() for x in t.encode([text])] == direct([text])
        assert len(t.known) < 14


def best_cost(places, fines, length):
    cost = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= length:
                cost[j] = min(cost[j], cost[i] + length - (places[j] - places[i]) + fines[j])
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_best_ones(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(5, 30))
    places = np.concatenate([[0], np.cumsum(rng.integers(1, length + 1, 40))])
    fines = rng.integers(0, 6, len(places))
    fines[[0, -1]] = 0
    cuts = packing.best_cuts(places, fines, length)
    assert cuts[0] == 0 and cuts[-1] == places[-1] and max(np.diff(cuts)) <= length
    index = {int(p): i for i, p in enumerate(places)}
    cost = sum(length - (b - a) + fines[index[b]] for a, b in zip(cuts, cuts[1:]))
    assert cost == best_cost(places.tolist(), fines.tolist(), length)


def check_pieces(pieces, texts, length=2048):
    """Every id once, offsets without gaps, ids right; returns the share of padding."""
    ids = {i: np.array([*x, 1], "<u4") for (i, _), x in zip(texts, direct([t for _, t in texts]))}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        of_doc[p.doc_id].append((p.start, p.length))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(of_doc) == set(ids)
    for i, spans in of_doc.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(ids[i])
    padding = total = 0
    for spans in of_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / (total + padding)


def test_pieces_cover_everything(spark):
    texts = list(enumerate(ODD)) + [(100 + i, prose(n, i)) for i, n in enumerate((3, 800, 5000, 1, 40))]
    got = packing.packed(documents(spark, texts, CLASHES).repartition(3)).collect()
    assert check_pieces(got, texts) < 0.2
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_padding_of_the_test_table_is_small(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_pieces(packing.packed(docs).collect(), texts) < 0.01


def test_stretches_hand_over_what_is_left():
    last = np.zeros(50, bool)
    last[7] = True
    rng = np.random.default_rng(0)
    packer, out, docs = packing.Packer(0, last, 16, 100), [], {}
    for i in range(60):
        docs[i] = rng.integers(0, 50, int(rng.integers(1, 60))).astype("<u4")
        out += packer.add(i, docs[i])
    out += packer.close()
    back, offsets = defaultdict(list), defaultdict(int)
    for doc, start, n, crc, total, sequence, offset in out:
        assert zlib.crc32(docs[doc][start : start + n].tobytes()) == crc and total == len(docs[doc])
        assert offset == offsets[sequence]
        offsets[sequence] += n
        back[doc].append((start, n))
    assert max(offsets.values()) <= 16
    assert all(sum(n for _, n in back[i]) == len(x) and back[i][0][0] == 0 for i, x in docs.items())


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in ([], [0], [5] * 9, rng.integers(0, 50257, 1000), rng.integers(0, 2**32, 77), [2**32 - 1]):
        ids = np.array(ids, np.uint32)
        assert bitplane.ids_of(bitplane.planes_of(ids, bits), len(ids), bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits,block", [(False, 1 << 16), (True, 64)])
def test_files_give_back_all_ids(spark, monkeypatch, bits, block):
    monkeypatch.setattr(bitplane, "BLOCK", block)
    texts = [(i * 7 % 101, t) for i, t in enumerate(ODD + [prose(700, 3)])] + [(None, "no id"), (7, "again")]
    got = bitplane.stored_ids(documents(spark, texts, CLASHES).repartition(4), bits=bits).collect()
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = {}
    at, want = 0, []
    for (i, t), x in zip(order, direct([t for _, t in order])):
        ids = np.array([*x, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ascending = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ascending == [i for i, _ in order]
    assert bitplane.stored_ids(spark.createDataFrame([], DOCS)).count() == 0
