"""Phrases of two and three words that occur together: counts as sorted streams, merged in lockstep.

Every n-gram with its count is a row. In prefix order a phrase follows its first word and its first
two words; in suffix order it follows its last ones. So one pass over each order, holding one word
and one pair, gives every phrase the counts of its parts and every pair its most frequent extension;
nothing is looked up by hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolweave.session import cut_lineage

from .common import given_back, shuffle_width, slices, stored

LEAST, SHARE, BEST, SCALE = 10, 50, 2000, 1_000_000
#: Bytes of text that a task counts at once.
CHUNK = 2 << 20
#: Different words, hashes of pairs, and phrases that a task adds up at once.
HELD = 1 << 20
HELD_PHRASES = 1 << 21
#: Bits of the filter of frequent pairs, 8 MB whatever the corpus: it only saves counting
#: phrases that cannot be frequent, for all it lets through are counted exactly.
FILTER_BITS = 1 << 26
SALTS = 64

_KIND = np.zeros(256, np.uint8)  # of bytes: 0 in words, 1 between words, 2 between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of UTF-8 ``data``; for each the place of its first byte, and whether the
    next word follows in the same piece."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    breaks = np.cumsum(kind == 2)[starts] if len(starts) else starts
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return words, starts, np.append(breaks[1:] == breaks[:-1], False)[: len(starts)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their parts."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _slots(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut at ends of pieces; a longer piece stays whole."""
    while len(text) > CHUNK:
        at = max(text.rfind(b, 0, CHUNK) for b in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\r"))
        if at < 0:
            break
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], bytes, np.ndarray, np.ndarray]]:
    """Documents together: languages, their texts with a line break behind each, and for each text
    its first byte and the number of its language."""
    langs: dict[str, int] = {}
    texts, owners, held = [], [], 0

    def out():
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        return list(langs), b"\n".join(texts) + b"\n", np.cumsum(sizes) - sizes, np.array(owners, np.int64)

    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in _cut((text or "").encode()):
                    if held and held + len(part) > CHUNK:
                        yield out()
                        langs, texts, owners, held = {}, [], [], 0
                    texts.append(part)
                    owners.append(langs.setdefault("und" if lang is None else lang, len(langs)))
                    held += len(part)
    if texts:
        yield out()


class Chunk:
    """The words of some documents as numbers: ``ids`` in ``known``, in the order of the texts;
    ``own`` the distinct (language, word) as language * count + word, ``place`` their index for each
    word; ``joined`` where the next word follows in the same piece."""

    def __init__(self, langs: list[str], data: bytes, firsts: np.ndarray, owners: np.ndarray) -> None:
        words, starts, self.joined = words_of(data)
        code = words.dictionary_encode()
        self.langs, self.known = langs, code.dictionary.cast(pa.string())
        self.ids, self.count = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(code.dictionary))
        lang = owners[np.searchsorted(firsts, starts, "right") - 1]
        self.own, self.place, self.n = np.unique(lang * self.count + self.ids, return_inverse=True, return_counts=True)

    def marks(self) -> np.ndarray:
        """A hash of language and word for each word."""
        words = _hashes(self.known.to_pylist())
        return _mixed(_hashes(self.langs)[self.own // self.count], words[self.own % self.count])[self.place] if len(self.own) else np.empty(0, np.uint64)

    def rows(self, lang: np.ndarray, parts: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        words = [self.known.take(pa.array(p)) for p in parts]
        phrase = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
        return pa.RecordBatch.from_arrays([pa.array(self.langs).take(pa.array(lang)), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for chunk in _chunks(batches):
        found = Chunk(*chunk)
        if len(found.own):
            yield found


class _Groups:
    """Rows lang, phrase, n with equal ones added up, over so many rows at least."""

    def __init__(self, most: int) -> None:
        self.held: list[pa.RecordBatch] = []
        self.most = most

    def add(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        self.held.append(batch)
        if sum(b.num_rows for b in self.held) > self.most:
            self.held = self.rest()
            if sum(b.num_rows for b in self.held) > self.most // 2:
                out, self.held = self.held, []
                return out
        return []

    def rest(self) -> list[pa.RecordBatch]:
        if len(self.held) < 2:
            return self.held
        table = pa.Table.from_batches(self.held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return table.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=50_000)


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes together, with the sum of their counts."""
    found, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(found)
    found, n = found[order], n[order]
    first = np.flatnonzero(np.diff(found, prepend=found[:1] + np.uint64(1)))
    return found[first], np.add.reduceat(n, first) if len(first) else n


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of the words, and hash, n of the pairs of words that follow each other, each
    added up over HELD different ones."""
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def pairs() -> Iterator[pa.RecordBatch]:
        for i in range(0, held, 50_000):
            found, n = pa.array(hashes[0][i : i + 50_000].view(np.int64)), pa.array(counts[0][i : i + 50_000])
            none = pa.nulls(len(found), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, found, n], ["lang", "phrase", "hash", "n"])

    def words(of: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.nulls(batch.num_rows, pa.int64()), batch.column("n")], ["lang", "phrase", "hash", "n"])

    singles = _Groups(HELD)
    for c in _chunked(batches):
        yield from words(singles.add(c.rows(c.own // c.count, [c.own % c.count], c.n)))
        marks = c.marks()
        at = np.flatnonzero(c.joined[:-1])
        found, n = np.unique(_mixed(marks[at], marks[at + 1]), return_counts=True)
        hashes, counts, held = [*hashes, found], [*counts, n.astype(np.int64)], held + len(found)
        if held > HELD:
            found, n = _added(hashes, counts)
            hashes, counts, held = [found], [n], len(found)
            if held > HELD // 2:
                yield from pairs()
                hashes, counts, held = [], [], 0
    yield from words(singles.rest())
    if held:
        found, n = _added(hashes, counts)
        hashes, counts, held = [found], [n], len(found)
        yield from pairs()


def _phrases(batches: Iterator[pa.RecordBatch], pairs) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of the pairs that pass the filter, and of three words that are two of them."""
    bits, groups = np.frombuffer(pairs.value, np.uint8), _Groups(HELD_PHRASES)
    for c in _chunked(batches):
        marks = c.marks()
        fine = np.append(c.joined[:-1] & _passes(bits, _mixed(marks[:-1], marks[1:])), False)
        at = np.flatnonzero(fine)
        keys, pair, n = np.unique(c.own[c.place[at]] * c.count + c.ids[at + 1], return_inverse=True, return_counts=True)
        lang, first, second = keys // c.count // c.count, keys // c.count % c.count, keys % c.count
        if len(keys):
            yield from groups.add(c.rows(lang, [first, second], n))
        number = np.zeros(len(fine), np.int64)
        number[at] = pair
        at = at[fine[at + 1]]
        keys, n = np.unique(number[at] * c.count + c.ids[at + 2], return_counts=True)
        of = keys // c.count
        if len(keys):
            yield from groups.add(c.rows(lang[of], [first[of], second[of], keys % c.count], n))
    yield from groups.rest()


def _summed(docs: DataFrame, count, kind: str, keys: list[str]) -> DataFrame:
    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = texts.mapInArrow(given_back(count), kind)
    return rows.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))  # rows are added up as far as a task can


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in batches:
        at = _slots(batch.column("hash").to_numpy().view(np.uint64))
        np.bitwise_or.at(bits, at >> 6, np.left_shift(np.int64(1), at & 63))
    used = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used])], ["slot", "bits"])


def _filter(frequent: DataFrame):
    """FILTER_BITS bits in which all hashes of ``frequent(hash)`` are marked, broadcast."""
    rows = frequent.select("hash").mapInArrow(_marked, "slot long, bits long")
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


# Streams ---------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range of the order tells its neighbours, one row: its last word and pair with their
    counts; its first phrase of three words, if it begins with one, and the largest count among
    those that share the first two words; whether nothing else is in it."""
    word = pair = first = None
    most, alone, lead = 0, True, True
    for r in _rows(batches):
        key = (r["lang"], *r["words"])
        if first is None and lead and len(key) == 4:
            first = key[:3]
        lead = lead and key[:3] == first and len(key) == 4
        if lead:
            most = max(most, r["a"])
        else:
            alone = False
        if len(key) == 2:
            word = (key, r["a"])
        elif len(key) == 3:
            pair = (key, r["a"])
    row = {
        "part": TaskContext.get().partitionId(), "first": first, "most": most, "alone": alone,
        "word": word and word[0], "word_n": word and word[1], "pair": pair and pair[0], "pair_n": pair and pair[1],
    }
    kind = pa.list_(pa.string())
    yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", kind), ("most", pa.int64()), ("alone", pa.bool_()), ("word", kind), ("word_n", pa.int64()), ("pair", kind), ("pair_n", pa.int64())]))


def _carries(ordered: DataFrame) -> dict[int, tuple]:
    """For every range, the word and the pair that are open where it begins, and the largest count
    in later ranges of a phrase that extends the pair open at its end. One row of a range is read."""
    ddl = "part int, first array<string>, most long, alone boolean, word array<string>, word_n long, pair array<string>, pair_n long"
    rows = sorted(ordered.mapInArrow(_edges, ddl).collect(), key=lambda r: r["part"])
    out, word, pair = {}, None, None
    for r in rows:
        out[r["part"]] = [word, pair, None, 0]
        word = (tuple(r["word"]), r["word_n"]) if r["word"] else word
        pair = (tuple(r["pair"]), r["pair_n"]) if r["pair"] else pair
    key, most = None, 0
    for r in reversed(rows):
        out[r["part"]][2:] = [key, most]
        if r["first"]:
            own = tuple(r["first"])
            most = max(r["most"], most if r["alone"] and own == key else 0)
            key = own
        elif not r["alone"]:
            key, most = None, 0
    return {p: tuple(v) for p, v in out.items()}


def _merged(batches: Iterator[pa.RecordBatch], carry) -> Iterator[dict]:
    """Rows of a range in order -> each with ``one`` and ``two``, the counts of its first word and
    first two words in this order, and ``longer``, the largest count of a phrase one word longer."""
    word, pair, after_key, after = carry.get(TaskContext.get().partitionId(), (None, None, None, 0))
    held, most = None, 0

    def closed() -> Iterator[dict]:
        if held is not None:
            yield held | {"longer": most}

    for r in _rows(batches):
        key = (r["lang"], *r["words"])
        r |= {"one": None, "two": None, "longer": 0}
        if len(key) == 4:
            r |= {"one": word[1], "two": pair[1]}
            if held is not None and pair[0] == key[:3]:
                most = max(most, r["a"])
            yield r
            continue
        yield from closed()
        if len(key) == 2:
            word, held = (key, r["a"]), None
            yield r
        else:
            pair, held, most = (key, r["a"]), r | {"one": word[1]}, 0
    if held is not None and after_key == pair[0]:
        most = max(most, after)
    yield from closed()


def _in_order(rows: DataFrame) -> DataFrame:
    """Dealt out by ranges of (lang, words) and sorted; checkpointed, so that ranges stay."""
    width = shuffle_width(rows.sparkSession)
    return cut_lineage(rows.repartitionByRange(width, "lang", "words").sortWithinPartitions("lang", "words"))


COLUMNS = [("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("longer", pa.int64())]
PREFIXED = "lang string, words array<string>, a long, l1 long, l2 long, longer long"


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _prefixed(batches: Iterator[pa.RecordBatch], carry) -> Iterator[pa.RecordBatch]:
    """In prefix order: adds the counts of the first word and pair; words come out reversed."""
    rows = ({"lang": r["lang"], "words": r["words"][::-1], "a": r["a"], "l1": r["one"], "l2": r["two"], "longer": r["longer"]} for r in _merged(batches, carry))
    return _batched(rows, pa.schema(COLUMNS))


def lowest(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The lowest score among cuts (count of the first part, count of the rest), the first of equal
    ones: score, l, r."""
    score, k = min((SCALE * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
    return score, *cuts[k]


FOUND = [("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())]


class _Backwards(str):
    """A string that sorts the other way round."""

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)

    def __gt__(self, other: str) -> bool:
        return str.__lt__(self, other)


def _suffixed(batches: Iterator[pa.RecordBatch], carry, share: int, best: int) -> Iterator[pa.RecordBatch]:
    """In suffix order: adds the counts of the last word and pair, drops what a longer phrase holds,
    scores the rest, and passes on the best rows of every language in this range."""

    def rows() -> Iterator[dict]:
        lang, heap = None, []
        for r in _merged_suffixes(batches, carry):
            if len(r["words"]) == 1 or 100 * r["longest"] >= share * r["a"]:
                continue
            if r["lang"] != lang:
                yield from (x[-1] for x in heap)
                lang, heap = r["lang"], []
            cuts = [(r["l1"], r["one"])] if len(r["words"]) == 2 else [(r["l1"], r["two"]), (r["l2"], r["one"])]
            score, left, right = lowest(r["a"], cuts)
            phrase = " ".join(reversed(r["words"]))
            row = {"lang": lang, "phrase": phrase, "a": r["a"], "l": left, "r": right, "score": score}
            item = (score, r["a"], _Backwards(phrase), row)
            if len(heap) < best:
                heapq.heappush(heap, item)
            elif item[:3] > heap[0][:3]:
                heapq.heapreplace(heap, item)
        yield from (x[-1] for x in heap)

    return _batched(rows(), pa.schema(FOUND))


def _merged_suffixes(batches: Iterator[pa.RecordBatch], carry) -> Iterator[dict]:
    def renamed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.rename_columns(["before" if n == "longer" else n for n in b.schema.names])

    for r in _merged(renamed(), carry):
        yield r | {"longest": max(r["before"], r["longer"])}


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """``docs(text, lang)`` -> lang, rank, phrase, a, l, r, n, score: each language's first ``best``
    phrases of two or three words by score, then a, both descending, then phrase.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and those at spaces
    and tabs into words. a counts a phrase, overlaps included; phrases below ``least`` are no
    candidates. The score is the lowest of floor(10^6 a a / (l r)) over the cuts into a first part
    (l) and the rest (r), of equal ones the first cut. A candidate is dropped if a longer one holds
    its words and comes up in at least ``share`` per cent of its places. n counts the language's
    words. Integers are Python's, so products have no bound.

    Null texts are empty; a null lang is ``und``, together with real ``und``. Repeated rows count as
    often as they stand there; other columns are not read. An empty table gives an empty result.

    Words are counted first, and pairs of words by a hash of 64 bits; then the pairs whose hash is
    frequent, and three words that are two such pairs, as they are: what falls below ``least``
    cannot be part of a candidate, so no count that matters is left out, and what two pairs of one
    hash let in fails the exact count.
    """
    enough = F.col("n") >= least
    found = stored(_summed(docs, _words_and_pairs, "lang string, phrase string, hash long, n long", ["lang", "phrase", "hash"]).filter((F.col("hash").isNull()) | enough), "words")
    words = found.filter("hash is null").drop("hash")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.filter(enough)
    pairs = _filter(found.filter("hash is not null"))
    longer = _summed(docs, partial(_phrases, pairs=pairs), "lang string, phrase string, n long", ["lang", "phrase"]).filter(enough)
    counts = words.unionByName(stored(longer, "phrases"))
    counts = counts.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    prefix = _in_order(counts)
    suffix = _in_order(prefix.mapInArrow(partial(_prefixed, carry=_carries(prefix)), PREFIXED))
    found = suffix.mapInArrow(partial(_suffixed, carry=_carries(suffix), share=share, best=best), "lang string, phrase string, a long, l long, r long, score long")
    # Each range passes on its best rows only; two levels of ranking keep the last one small.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = found.withColumn("salt", F.spark_partition_id() % SALTS)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
