"""SimHash near duplicates: fingerprints, Golay-code keys, verified links and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, given_back, row_keys, shuffle_width, slices, stored, unique_ids
from .components import connected_components
from .golay import codeword_indices

WORDS, SEED, BITS = 3, 42, 3
#: Distinct fingerprints of one key that a task compares at once; larger keys are cut into blocks.
BLOCK = 8192
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    each = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.fromiter(map(xxhash.xxh64_intdigest, each, [seed] * len(each)), np.uint64, len(each))


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bit i is set if it is set in more than half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 8 << 20):
            prints = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column("text")]
            values = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), values], ["_row", "fp"])


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for 64-bit fingerprints; any two within three bits share a key.

    The fingerprint is cut into segments of 23, 23 and 18 bits. Three errors fall either into one
    segment, and the other two are equal (three exact keys), or leave at most two in each, and
    then the segments share a codeword each (a key for every triple of near codewords).
    """
    a, b, c = prints & 0x7FFFFF, (prints >> 23) & 0x7FFFFF, (prints >> 46) & 0x3FFFF
    rows = np.arange(len(prints))
    ca, cb, cc = (codeword_indices(x) for x in (a, b, c))
    triple = (ca[:, :, None, None] << 24) | (cb[:, None, :, None] << 12) | cc[:, None, None, :]
    valid = (ca >= 0)[:, :, None, None] & (cb >= 0)[:, None, :, None] & (cc >= 0)[:, None, None, :]
    exact = np.stack([(1 << 60) | (a << 23) | b, (2 << 60) | (a << 18) | c, (3 << 60) | (b << 18) | c], axis=1)
    keys = [triple[valid], exact.ravel()]
    return np.concatenate([np.nonzero(valid)[0], np.repeat(rows, 3)]), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        for i in range(0, len(prints), 1024):
            part = prints[i : i + 1024]
            rows, keys = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def forest(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints: connected exactly
    where the links connect them, and fewer edges than fingerprints."""
    left, one, two = prints, [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found, left = left[near], left[~near]
                one.append(np.full(len(found), at))
                two.append(found)
                frontier.extend(found)
    none = np.empty(0, prints.dtype)
    return np.concatenate(one or [none]), np.concatenate(two or [none])


def _small_links(prints: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    out = []
    run = np.repeat(np.arange(len(sizes)), sizes)
    for d in range(1, int(sizes.max(initial=1))):
        same = (run[d:] == run[:-d]) & (np.bitwise_count(prints[d:] ^ prints[:-d]) <= BITS)
        if same.any():
            out.append((prints[:-d][same], prints[d:][same]))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows -> links (kind 0: a, b), or the rows of keys with more than BLOCK
    fingerprints (kind 1: key, a = fp, b = block). At most BLOCK rows of a key are held."""

    def rows(kind: int, key, a, b) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.broadcast_to(np.asarray(key, np.int64), n).copy()), pa.array(a.view(np.int64)), pa.array(np.asarray(b).view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["kind", "key", "a", "b"])

    held_keys, held, large, passed = np.empty(0, np.int64), np.empty(0, np.uint64), None, 0
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "fp"])
    for last, batch in _with_end(batches, empty):
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        prints = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
        if large is not None:
            n = int(np.searchsorted(keys, large, "right"))
            if n:
                yield rows(1, large, prints[:n], (passed + np.arange(n)) // BLOCK)
            passed, keys, prints = passed + n, keys[n:], prints[n:]
            if len(keys):
                large = None
        if not len(keys):
            held_keys, held = keys, prints
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        done = len(starts) if last else len(starts) - 1
        end = len(keys) if last else starts[-1]
        links = []
        for i in np.flatnonzero(sizes[:done] > 8):
            group = prints[starts[i] : starts[i] + sizes[i]]
            if sizes[i] > BLOCK:
                yield rows(1, keys[starts[i]], group, np.arange(sizes[i]) // BLOCK)
            else:
                links.append(forest(group))
        small = np.repeat(sizes[:done] <= 8, sizes[:done])
        if small.any():
            links += _small_links(prints[:end][small], sizes[:done][sizes[:done] <= 8])
        held_keys, held = keys[end:], prints[end:]
        if len(held) > BLOCK:
            large, passed = held_keys[0], len(held)
            yield rows(1, large, held, np.arange(len(held)) // BLOCK)
            held_keys, held = held_keys[:0], held[:0]
        if links:
            a, b = (np.concatenate(x) for x in zip(*links))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield rows(0, 0, np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]))


def _with_end(batches, empty):
    for batch in batches:
        yield False, batch
    yield True, empty


def _block_links(table: pa.Table) -> pa.Table:
    a, b = forest(np.unique(table.column("a").to_numpy().view(np.uint64)))
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Distinct ``prints(fp)`` -> (a, b): links that connect exactly what links of at most three
    differing bits connect. Copies are gone before, so the work follows distinct fingerprints."""
    # A few bytes of input become 152 rows here: as many tasks as the shuffle that follows has.
    spread = prints.select("fp").repartition(shuffle_width(prints.sparkSession), "fp")
    keys = spread.mapInArrow(_key_rows, "key long, fp long")
    found = stored(
        keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linked, "kind int, key long, a long, b long"),
        "links",
    )
    links = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1")
    blocks = large.groupBy("key").agg((F.max("b") + 1).alias("n"))
    pairs = large.join(blocks, "key").select("key", "a", F.col("b").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("key", "a", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return links.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Words of 3-word shingles are what stands between white space after lower-casing A-Z; shorter
    texts are one shingle; texts without a word have fingerprint zero and link like any other.
    Fingerprints link at three or fewer differing bits, and component_id is the smallest doc_id
    reachable. Null texts are empty. Repeated ids are separate rows with the same id; rows without
    an id get the component_id of their group, null if no row of it has one. Whole texts are
    read, eight megabytes of them at a time. An empty table gives an empty result.
    """
    return near_groups(docs).select("doc_id", "fingerprint", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the row keys ``_row`` and ``_first`` (the row that stays)."""
    unique = unique_ids(docs)
    keyed = row_keys(docs.select("doc_id", "text"), unique=unique)
    rows = stored(keyed.select("_row", "text").mapInArrow(given_back(_fingerprints), "_row long, fp long"), "prints")
    classes = stored(rows.groupBy("fp").agg(F.min("_row").alias("first"), F.count("*").alias("n")), "classes")
    links = fingerprint_links(classes)
    ends = links.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(
        classes.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b"
    )
    parts = connected_components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))
    # Only fingerprints with copies or links have a row to look up; the others are their own group.
    groups = stored(
        classes.join(parts, F.col("first") == F.col("node"), "left")
        .select("fp", F.coalesce("component", "first").alias("_first"), "n", "component")
        .filter("n > 1 or component is not null")
        .select("fp", "_first"),
        "groups",
    )
    out = rows.join(groups, "fp", "left").select(
        "_row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("_first", "_row").alias("_first")
    )
    if unique:
        kind = docs.schema["doc_id"].dataType
        return out.withColumns({"doc_id": F.col("_row").cast(kind), "component_id": F.col("_first").cast(kind)})
    ids = keyed.select("_row", "doc_id")
    return out.join(ids, "_row").join(ids.select(F.col("_row").alias("_first"), F.col("doc_id").alias("component_id")), "_first")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """``docs`` with the first document of each component; all columns stay as they are.

    Without ``similarity`` components are those of ``near_duplicates``. With it two documents link
    where their sets of ``words``-word shingles have at least that Jaccard similarity: see
    ``similar``, which finds candidates by Golay keys too.
    """
    if similarity is not None:
        from .similar import without_similar

        return without_similar(docs, words, similarity)
    name = free_name(docs, "_row")
    keyed = row_keys(docs, name)
    found = near_groups(keyed.select(F.col(name).alias("doc_id"), "text"))
    dropped = found.filter("_row <> _first").select(F.col("_row").alias(name))
    return keyed.join(dropped, name, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
