"""Near duplicates by the Jaccard similarity of five-word shingles: Golay keys of fingerprints find
the candidates, the shingles themselves decide.

A copy with a few words changed keeps nearly all of its distinct words. A fingerprint has 256 bits,
each a bit of the smallest of the words' hashes: two texts whose words have similarity J differ in a
share (1 - J) / 2 of them, where majority bits, as in ``simhash``, would differ in one that falls
with the root of 1 - J only. Many overlapping samples of three times 23 bits are decoded to their
nearest Golay codewords. Segments that differ in a few bits often decode alike, and a pair needs one
sample in which all three do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, given_back, row_keys, shuffle_width, slices, stored
from .components import connected_components
from .golay import codeword_indices
from .simhash import LOWER, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Numbers of a fingerprint (64 bits each); samples of it, each a key; bits of a segment; bits in
#: which candidates may differ.
LANES, KEYS, SEGMENT, FAR = 4, 96, 23, 64
#: Rows of a key of which all pairs are candidates; rows that are compared at once beyond that, and
#: how many of the nearest are candidates at first.
FEW, BLOCK, NEAREST = 6, 1024, 1
#: Sides of a cell of sets: rows of small groups, cells across up to which they are small, shingles.
SMALL, ACROSS, SHINGLES = 256, 16, 1 << 20


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 64 * LANES, np.uint64) << np.uint64(1) | np.uint64(1)


def word_print(text: str | None, block: int = 1 << 12) -> np.ndarray:
    """Fingerprint of the distinct words: LANES numbers of 64 bits. Every bit has its own order of
    hashes, and is a bit of the hash that comes first; all are 0 for a text without a word."""
    words = list(set((text or "").encode().translate(LOWER).split()))
    return least_bits(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), block)


def least_bits(hashes: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    if not len(hashes):
        return np.zeros(LANES, "<u8")
    least = np.full(64 * LANES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), block):
        least = np.minimum(least, (hashes[i : i + block, None] * _factors()).min(axis=0))
    least = (least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.packbits((least >> np.uint64(40) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            found = np.stack([word_print(t.as_py()) for t in batch.column("text")]).astype("<u8")
            cells = pa.Array.from_buffers(pa.binary(8 * LANES), len(found), [None, pa.py_buffer(np.ascontiguousarray(found))])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), cells.cast(pa.binary())], ["_row", "fp"])


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, LANES)


@cache
def samples(keys: int) -> np.ndarray:
    """Places of the bits of every key: [keys, 3, SEGMENT], always the same."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(64 * LANES)[: 3 * SEGMENT].reshape(3, SEGMENT) for _ in range(keys)])


def word_keys(prints: np.ndarray, keys: int = KEYS) -> np.ndarray:
    """[rows, keys] numbers: for every sample of bits the nearest codewords of its three segments,
    12 bits each, behind the number of the sample."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    weights = 1 << np.arange(SEGMENT, dtype=np.int32)
    out = np.empty((len(prints), keys), np.int64)
    for k, places in enumerate(samples(keys)):
        out[:, k] = k
        for segment in places:
            out[:, k] = out[:, k] << 12 | codeword_indices(bits[:, segment] @ weights)[:, 0]
    return out


def _keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            found = word_keys(_lanes(part.column("fp")), keys)
            rows = np.repeat(part.column("_row").to_numpy(), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(rows)], ["key", "_row"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sorted (key, _row) in pieces of whole keys, and rows of a key too large for that (True)."""
    keys, rows, large = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        keys, rows = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((keys, "key"), (rows, "_row")))
        if large is not None:
            n = int(np.searchsorted(keys, large, "right"))
            if n:
                yield keys[:n], rows[:n], True
            keys, rows = keys[n:], rows[n:]
            large = None if len(keys) else large
        if len(keys):
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield keys[:end], rows[:end], False
            keys, rows = keys[end:], rows[end:]
            if len(keys) > FEW:
                yield keys, rows, True
                large, keys, rows = keys[0], keys[:0], rows[:0]
    if len(keys):
        yield keys, rows, False


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, _row) -> all pairs of a key with FEW rows (kind 0: a, b), and the rows of larger
    keys (kind 1: a = key, b = row)."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    for keys, ids, large in _runs(batches):
        if large:
            yield rows(1, keys, ids)
            continue
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
        if (sizes > FEW).any():
            yield rows(1, keys[sizes > FEW], ids[sizes > FEW])
        keys, ids = keys[sizes <= FEW], ids[sizes <= FEW]
        for d in range(1, FEW):
            same = keys[d:] == keys[:-d]
            if same.any():
                yield rows(0, ids[:-d][same], ids[d:][same])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, _row, fp) sorted by key -> of BLOCK of a key at a time, the NEAREST of each row."""

    def links(ids: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids) < 2:
            return
        far = sum(np.bitwise_count(prints[:, None, i] ^ prints[None, :, i]).astype(np.int32) for i in range(LANES))
        np.fill_diagonal(far, 10_000)
        near = np.argsort(far, axis=1, kind="stable")[:, :NEAREST]
        a, b = np.repeat(ids, near.shape[1]), ids[near.ravel()]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    key, ids, prints = None, [], []
    for batch in batches:
        keys, rows, lanes = batch.column("key").to_numpy(), batch.column("_row").to_numpy(), _lanes(batch.column("fp"))
        first = 0
        while first < len(keys):
            if keys[first] != key or sum(map(len, ids)) >= BLOCK:
                if ids:
                    yield from links(np.concatenate(ids), np.concatenate(prints))
                key, ids, prints = keys[first], [], []
            stop = min(int(np.searchsorted(keys, key, "right")), first + BLOCK - sum(map(len, ids)))
            ids.append(rows[first:stop])
            prints.append(lanes[first:stop])
            first = stop
    if ids:
        yield from links(np.concatenate(ids), np.concatenate(prints))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose fingerprints differ in FAR bits at most."""
    for batch in batches:
        if batch.num_rows:
            far = np.bitwise_count(_lanes(batch.column("fp_a")) ^ _lanes(batch.column("fp_b"))).sum(axis=1)
            kept = batch.filter(pa.array(far <= FAR))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            found = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column("text")]
            more = [c for c in batch.schema.names if c not in ("_row", "text")]
            cols = [batch.column("_row"), pa.array(found, pa.list_(pa.int64())), *(batch.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "shingles", *more])


def _united(parent: dict[int, int], a: int, b: int) -> bool:
    """Whether a and b were apart; they are one from now on."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = root(a), root(b)
    parent[a] = b
    return a != b


def _ends(pairs: list[tuple[int, int]]) -> pa.Table:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(both.min(axis=1)), "b": pa.array(both.max(axis=1))})


def _near_parts(table: pa.Table) -> pa.Table:
    """The odd rows of a key (side 0) against rows of it (side 1): a spanning forest of the components
    that have rows of near enough fingerprints, so fewer pairs than rows."""
    side, parts, prints = table.column("side").to_numpy(), table.column("part").to_numpy(), _lanes(table.column("fp"))
    names, parts = np.unique(parts, return_inverse=True)
    odd, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    parent, out = {}, []
    for i in range(0, len(odd), 128):
        at = odd[i : i + 128]
        far = sum(np.bitwise_count(prints[at, None, k] ^ prints[None, all_, k]).astype(np.int32) for k in range(LANES))
        x, y = np.nonzero((far <= FAR) & (parts[at][:, None] != parts[all_][None, :]))
        for pair in np.unique(parts[at][x] * len(names) + parts[all_][y]).tolist():
            a, b = divmod(pair, len(names))
            if _united(parent, a, b):
                out.append((names[a], names[b]))
    return _ends(out)


def _similar_rows(table: pa.Table, similarity: float) -> pa.Table:
    """The odd rows of a group (side 0) against rows of it (side 1) by their sets: a spanning forest of
    what pairs of the similarity connect beyond the components, so fewer pairs than rows."""
    side, rows, parts = (table.column(c).to_numpy() for c in ("side", "_row", "part"))
    sets = table.column("shingles").combine_chunks()
    sizes, starts = sets.value_lengths().to_numpy(), sets.offsets.to_numpy()
    values = sets.values.to_numpy()
    odd, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(odd) or not len(all_):
        return _ends([])
    held = np.concatenate([values[starts[j] : starts[j] + sizes[j]] for j in all_])
    order = np.argsort(held, kind="stable")
    owners = np.repeat(np.arange(len(all_)), sizes[all_])[order]
    words, first = np.unique(held[order], return_index=True)
    first = np.append(first, len(held))
    parent, out = {}, []
    for i in odd:
        own = values[starts[i] : starts[i] + sizes[i]]
        at = np.searchsorted(words, own)
        known = at < len(words)
        at = at[known][words[at[known]] == own[known]]
        length = first[at + 1] - first[at]
        places = np.arange(length.sum()) + np.repeat(first[at] - np.cumsum(length) + length, length)
        shared = np.bincount(owners[places], minlength=len(all_))
        near = np.flatnonzero((shared >= similarity * (sizes[i] + sizes[all_] - shared)) & (parts[all_] != parts[i]))
        for j in all_[near]:
            if _united(parent, int(parts[i]), int(parts[j])):
                out.append((rows[i], rows[j]))
    return _ends(out)


def _cells(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows with their ``part`` and of their group ``main``, ``down`` and ``across`` -> cells of the
    group (group, i, j): odd rows, which are not of the main part, as side 0 in every j, and all rows
    as side 1 in every i."""
    at = F.xxhash64(group, "_row")
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    odd = F.transform(to("across"), lambda j: F.struct(F.lit(0).alias("side"), F.pmod(at, "down").alias("i"), j.alias("j")))
    all_ = F.transform(to("down"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.pmod(at, "across").alias("j")))
    cell = F.explode(F.when(F.col("part") != F.col("main"), F.concat(odd, all_)).otherwise(all_)).alias("cell")
    return rows.select(group, "_row", "part", *columns, cell).select(group, "_row", "part", *columns, "cell.*").groupBy(group, "i", "j")


def candidates(prints: DataFrame, keys: int = KEYS) -> tuple[DataFrame, DataFrame]:
    """``prints(_row, fp)`` -> distinct (a, b), a < b: pairs that share a key, and (key, _row, fp) of
    the keys of which not all pairs are among them.

    A key with more than FEW rows is cut into blocks, in the order of the rows' hash, and each row
    is paired with its NEAREST fingerprints there. Blocks of other keys hold other rows, so that in
    a large group a row meets those closest to it; ``open_links`` has what these leave open.
    """
    spread = prints.repartition(shuffle_width(prints.sparkSession), "_row")
    rows = spread.mapInArrow(given_back(partial(_keys, keys=keys)), "key long, _row long")
    found = stored(rows.repartition("key").sortWithinPartitions("key", "_row").mapInArrow(given_back(_pairs), "kind int, a long, b long"), "near-pairs")
    large = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("_row"))
    large = stored(large.join(prints, "_row").select("key", "_row", "fp"), "large-keys")
    blocks = large.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "_row"))
    near = blocks.mapInArrow(given_back(_nearest), "a long, b long")
    return found.filter("kind = 0").select("a", "b").unionByName(near).distinct(), large


def open_links(rows: DataFrame, large: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that connect what ``links`` leave apart of all pairs of a large key that have the
    similarity. With them the components are those of all pairs of the key.

    In a key, the component with most rows need not be compared with itself: the others, the odd
    rows, are compared with all rows by their fingerprints, in cells of about BLOCK times BLOCK, each
    a task's group. That says which components are near each other in any key. The groups of near
    components share no rows, so in these the sets themselves are compared, once instead of in every
    key, in cells again. A cell has fewer pairs than rows, whatever the number of near rows.
    """
    parts = connected_components(links)
    held = large.join(parts, F.col("_row") == F.col("node"), "left")
    held = stored(held.select("key", "_row", "fp", F.coalesce("component", "_row").alias("part")), "key-parts")
    sizes = held.groupBy("key", "part").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("main")).filter("n > main.n")
    blocks = lambda n, most: F.ceil(n / F.lit(most)).cast("long")
    n, odd = F.col("n"), F.col("n") - F.col("main.n")
    keys = stored(keys.select("key", F.col("main.part").alias("main"), blocks(n, BLOCK).alias("across"), blocks(odd, BLOCK).alias("down")), "open-keys")
    held = stored(held.join(keys, "key"), "open-rows")
    near = _cells(held, "key", ["fp"]).applyInArrow(_near_parts, "a long, b long")
    groups = connected_components(near)
    members = held.select("_row", "part").distinct().join(groups, F.col("part") == F.col("node"))
    members = stored(members.select("_row", "part", F.col("component").alias("group")), "near-groups")
    texts = rows.select("_row", "text").join(members, "_row").select("_row", "text", "part", "group")
    schema = "_row long, shingles array<long>, part long, group long"
    sets = stored(texts.mapInArrow(given_back(partial(_shingles, words=words)), schema), "group-sets")
    sizes = sets.groupBy("group", "part").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("w"))
    sizes = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "part", "w")).alias("main"))
    # Cells of few rows spread a small group over tasks; those of a large one have up to BLOCK times BLOCK.
    side = lambda n, w: F.greatest(F.least(blocks(n, SMALL), F.greatest(F.lit(ACROSS).cast("long"), blocks(n, BLOCK))), blocks(w, SHINGLES))
    across, down = side(n, F.col("w")), side(odd, F.col("w") - F.col("main.w"))
    sizes = stored(sizes.select("group", F.col("main.part").alias("main"), across.alias("across"), down.alias("down")), "group-cells")
    cells = _cells(sets.join(sizes, "group"), "group", ["shingles"])
    return cells.applyInArrow(lambda table: _similar_rows(table, similarity), "a long, b long").distinct()


def similar_links(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, keys: int = KEYS) -> DataFrame:
    """``rows(_row, text)`` -> (a, b): candidates whose sets of shingles have at least the Jaccard
    similarity; they connect what all such pairs that share a key connect."""
    prints = stored(rows.select("_row", "text").mapInArrow(given_back(_prints), "_row long, fp binary"), "word-prints")
    pairs, large = candidates(prints, keys)
    sides = [prints.select(F.col("_row").alias(c), F.col("fp").alias(f"fp_{c}")) for c in ("a", "b")]
    close = pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_close, "a long, b long")
    links = stored(verified(rows, close, words, similarity), "links")
    if large.isEmpty():
        return links
    return links.unionByName(open_links(rows, large, links, words, similarity))


def verified(rows: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs that have the similarity. Sets are made only of rows that are candidates, and compared
    in the JVM."""
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()
    sets = rows.select("_row", "text").join(wanted, "_row", "left_semi")
    sets = stored(sets.mapInArrow(given_back(partial(_shingles, words=words)), "_row long, shingles array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("_row").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("_row").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - shared
    return both.filter((shared >= F.lit(similarity) * either)).select("a", "b")


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, keys: int = KEYS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, component_id, the smallest doc_id that links
    reach. Two texts link where their sets of ``words``-word shingles have a Jaccard similarity of
    at least ``similarity``; shingles are those of ``simhash``, and texts without a word link to
    each other. Candidates come from keys, so a link is found with a probability that grows
    with the similarity; what is linked is exact. Null ids stay null; an empty table is empty."""
    keyed = row_keys(docs.select("doc_id", "text"))
    parts = connected_components(similar_links(keyed, words, similarity, keys))
    ids = keyed.select("_row", "doc_id")
    first = F.coalesce("component", "_row")
    found = ids.join(parts, F.col("_row") == F.col("node"), "left").select("doc_id", first.alias("_first"))
    return found.join(ids.select(F.col("_row").alias("_first"), F.col("doc_id").alias("component_id")), "_first").select("doc_id", "component_id")


def without_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, keys: int = KEYS) -> DataFrame:
    """``docs`` with the first document of each group; all columns stay as they are."""
    name = free_name(docs, "_row")
    keyed = row_keys(docs, name)
    links = similar_links(keyed.select(F.col(name).alias("_row"), "text"), words, similarity, keys)
    parts = connected_components(links)
    dropped = parts.filter("node <> component").select(F.col("node").alias(name))
    return keyed.join(dropped, name, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
