"""Repeated byte strings: sorted anchor suffixes, compared with their neighbours.

Sorting every suffix of a corpus would move each byte hundreds of times. Here only *anchors* are
sorted: the positions whose 32-byte gram has the smallest hash in some 200-byte string. Equal
200-byte strings have the same anchors at the same places, so a repeated string is always found
from an anchor that occurs at least twice. About 1.2 % of all positions are anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, free_name, given_back, row_keys, shuffle_width, slices, stored, unique_ids

LENGTH, GRAM = 200, 32
#: Bytes before an anchor that a 200-byte string around it can reach.
BEFORE = LENGTH - GRAM
#: Bytes of text that a task turns into hashes at once, and contexts of one gram compared at once.
PIECE, GROUP = 1 << 18, 100_000
#: Anchors of a range of the sorted order, about.
RANGE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
TOP = np.uint32(0xFFFFFFFF)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random number for every byte."""
    n = PIECE + 4 * LENGTH + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 2**64))
        down = np.cumprod(np.full(n, pow(BASE, -1, 2**64), np.uint64)) * np.uint64(BASE)
    return up, down, np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over a[i : i + width] for every i with a full window, by doubling."""
    span = 1
    while 2 * span <= width:
        a, span = op(a[:-span], a[span:]), 2 * span
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, context hash) in the texts that ``ends`` cuts ``data`` into.

    The context of an anchor is the part of its text within 168 bytes before and 200 bytes after
    it, and how far it reaches is part of its hash.
    """
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2
    up, down, numbers = _powers()
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers[data] * up[:n], out=prefix[1:])
        grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n + 1 - GRAM])
    short = (grams >> np.uint64(32)).astype(np.uint32)
    lowest = _sliding(np.minimum, short, LENGTH - GRAM + 1)
    # A string that crosses the end of a text counts as nothing: no hash is as small as 0.
    np.maximum(lowest, 1, out=lowest)
    for end in ends:
        lowest[max(0, end - LENGTH + 1) : end] = 0
    edge = np.zeros(LENGTH - GRAM, np.uint32)
    highest = _sliding(np.maximum, np.concatenate([edge, lowest, edge]), LENGTH - GRAM + 1)
    at = np.flatnonzero(highest == np.maximum(short, 1))
    text = np.searchsorted(ends, at, "right")
    first = np.maximum(at - BEFORE, np.concatenate([[0], ends])[text])
    last = np.minimum(at + LENGTH, ends[text])
    with np.errstate(over="ignore"):
        context = _mixed((prefix[last] - prefix[first]) * down[first] + _mixed((at - first).astype(np.uint64) * np.uint64(512) + (last - at).astype(np.uint64)))
    return at, grams[at], context


def _text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, position, gram, context), in pieces of bounded size."""
    group: list[int] = []

    def together():
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes)
        at, gram, context = anchors(data, ends)
        which = np.searchsorted(ends, at, "right")
        return np.array(group)[which], at - (ends - sizes)[which], gram, context

    held = 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > PIECE:
            yield from (_long_anchors(i, text))
            continue
        if held + len(text) > PIECE:
            yield together()
            group, held = [], 0
        group.append(i)
        held += len(text)
    if group:
        yield together()


def _long_anchors(i: int, text: bytes) -> Iterator[tuple]:
    """Pieces of a long text overlap by what decides about an anchor and its context."""
    margin = 2 * LENGTH
    for start in range(0, len(text), PIECE):
        first, last = max(0, start - margin), min(len(text), start + PIECE + margin)
        at, gram, context = anchors(np.frombuffer(text, np.uint8)[first:last], np.array([last - first]))
        own = (at + first >= start) & (at + first < start + PIECE)
        yield np.full(own.sum(), i), at[own] + first, gram[own], context[own]


def _utf8(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            rows = batch.column("_row").to_numpy()
            for i, at, gram, context in _text_anchors(_utf8(batch.column("text"))):
                cols = [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rows[i]), pa.array(at)]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "context", "_row", "pos"])


#: What the sorted order says about an anchor. OPEN and above are for what meets an end of a range:
#: one is added if the range has several rows of the context, two if it has several of the gram.
INSIDE, ALONE, MODEL, OPEN = 0, 1, 2, 3
SORTED = "gram long, context long, _row long, pos long, kind int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of anchors -> those whose gram is repeated, by their neighbours:
    INSIDE (its whole context is repeated), ALONE (its context is not, other contexts of the gram
    exist), MODEL (the first of a repeated context, for the lone ones to be compared with).

    The next range can only add to the first and the last context of this one: each of these two
    leaves one OPEN row as well, or instead where it has a single row.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found).combine_chunks()
    gram, context = (rows.column(c).to_numpy() for c in ("gram", "context"))
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_class = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    g, c = np.cumsum(new_gram) - 1, np.cumsum(new_class) - 1
    repeated = np.bincount(c)[c] > 1
    several = np.bincount(g[new_class])[g] > 1
    edge = (c == 0) | (c == c[-1])
    known = np.flatnonzero(repeated | (several & ~edge))
    models = np.flatnonzero(~edge & new_class & repeated & several)
    ends = np.flatnonzero(edge & new_class)
    chosen = np.concatenate([known, models, ends])
    kinds = np.concatenate([np.where(repeated[known], INSIDE, ALONE), np.full(len(models), MODEL), OPEN + repeated[ends] + 2 * several[ends]])
    for i in range(0, len(chosen), 1 << 16):
        part = rows.take(pa.array(chosen[i : i + (1 << 16)])).append_column("kind", pa.array(kinds[i : i + (1 << 16)].astype(np.int32)))
        yield from part.combine_chunks().to_batches()


def _closed(ends: DataFrame) -> DataFrame:
    """The comparison across the ends of ranges, on at most two rows of each range."""
    mark = F.col("kind") - OPEN
    classes = ends.groupBy("gram", "context").agg(
        F.sum(F.lit(1) + mark % 2).alias("n"), F.max(mark).alias("mark"), F.min(F.struct("_row", "pos")).alias("first")
    )
    grams = classes.groupBy("gram").agg(((F.count("*") > 1) | (F.max("mark") >= 2)).alias("several"))
    classes = classes.join(grams, "gram")
    single = ends.filter(mark % 2 == 0).drop("kind").join(classes, ["gram", "context"])
    kind = F.when(F.col("n") > 1, INSIDE).otherwise(ALONE).alias("kind")
    out = single.filter("n > 1 or several").select("gram", "context", "_row", "pos", kind)
    models = classes.filter("n > 1 and several").select("gram", "context", "first._row", "first.pos", F.lit(MODEL).alias("kind"))
    return out.unionByName(models)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their lone and model anchors -> one row per anchor with its bytes."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for row, text, marks in zip(batch.column("_row").to_pylist(), _utf8(batch.column("text")), batch.column("marks").to_pylist()):
                for m in marks:
                    p = m["pos"]
                    left = text[max(0, p - BEFORE) : p]
                    for x, v in zip(out, (m["gram"], row, p, m["kind"], left, text[p : p + LENGTH])):
                        x.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield from pa.table([pa.array(x, t) for x, t in zip(out, types)], ["gram", "_row", "pos", "kind", "before", "after"]).to_batches()


def multikey_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of rows by (group, words[:, 0], words[:, 1], ...): multikey quicksort, level by level.
    Each level sorts only the rows that all earlier words leave tied."""
    order = np.argsort(group, kind="stable")
    tied = group[order]
    for j in range(words.shape[1]):
        repeated = np.concatenate([[False], tied[1:] == tied[:-1]])
        active = np.flatnonzero(repeated | np.append(repeated[1:], False))
        if not len(active):
            break
        word = words[order[active], j]
        by = np.lexsort([word, tied[active]])
        order[active], word, label = order[active][by], word[by], tied[active][by]
        new = np.concatenate([[True], (label[1:] != label[:-1]) | (word[1:] != word[:-1])])
        # Labels must stay apart from those of rows that are settled: use positions in the order.
        tied = np.full(len(tied), -1, np.int64)
        settled = np.ones(len(tied), bool)
        settled[active] = False
        tied[settled] = np.flatnonzero(settled)
        tied[active] = active[new][np.cumsum(new) - 1]
    return order


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Fixed-width rows, zero-filled; a multiple of eight wide."""
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _neighbours(group: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common prefix of each row with the one before it (-1: other group)."""
    order = multikey_order(group, bytes_.view(">u8").astype(np.uint64).reshape(len(group), -1))
    common = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 1 << 14):
        a, b = order[i : i + (1 << 14)], order[i - 1 : i - 1 + len(order[i : i + (1 << 14)])]
        differs = bytes_[a] != bytes_[b]
        length = np.where(differs.any(axis=1), differs.argmax(axis=1), bytes_.shape[1])
        common[i : i + len(a)] = np.where(group[a] == group[b], length, -1)
    return order, common


def repeated_around(group: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every row the smallest and largest offset at which a 200-byte string around its anchor
    also occurs around another anchor of its group; (1, 0) where there is none.

    The suffixes after the anchors and the reversed texts before them are sorted. A string with
    ``o`` bytes before the anchor is repeated if another row is in the same interval of common
    prefixes >= 200 - o of the first order and >= o of the second.
    """
    n = len(group)
    right, left = _matrix(after, LENGTH), _matrix([x[::-1] for x in before], BEFORE)
    r_size, l_size = np.array([len(x) for x in after]), np.array([len(x) for x in before])
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    orders = [_neighbours(group, right), _neighbours(group, left)]
    most = []
    for (order, common), size in zip(orders, (r_size, l_size)):
        best = np.maximum(common, np.append(common[1:], -1))
        reach = np.empty(n, np.int64)
        reach[order] = best
        most.append(np.minimum(reach, size))
    most_r, most_l = most
    maybe = most_r + most_l >= LENGTH
    for o in range(BEFORE + 1):
        at = np.flatnonzero(maybe & (most_r >= LENGTH - o) & (most_l >= o))
        if len(at) < 2:
            continue
        interval = []
        for (order, common), least in zip(orders, (LENGTH - o, o)):
            ids = np.empty(n, np.int64)
            ids[order] = np.cumsum(common < least)
            interval.append(ids[at])
        pair = interval[0] * (n + 1) + interval[1]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        hit = at[by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        low[hit] = np.where(high[hit] < low[hit], o, low[hit])
        high[hit] = o
    # The first hit of a row sets low; later ones only move high.
    return low, high


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> spans of lone anchors. Whole grams are compared together, as many
    as make up some 30,000 rows; no gram has more than GROUP."""

    def spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.unique(rows.column("gram").to_numpy(), return_inverse=True)[1]
        low, high = repeated_around(group, rows.column("before").to_pylist(), rows.column("after").to_pylist())
        hit = (high >= low) & (rows.column("kind").to_numpy() == ALONE)
        row, pos = rows.column("_row").to_numpy()[hit], rows.column("pos").to_numpy()[hit]
        cols = [pa.array(row), pa.array(pos - high[hit]), pa.array(pos - low[hit] + LENGTH)]
        yield from pa.table(cols, ["_row", "first", "last"]).to_batches()

    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows < 1 << 15:
            continue
        held = held.combine_chunks()
        grams = held.column("gram").to_numpy()
        start = int(np.searchsorted(grams, grams[-1]))
        if start:
            yield from spans(held.slice(0, start))
            held = held.slice(start)
    if held is not None and held.num_rows:
        yield from spans(held.combine_chunks())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every 200-byte string around an anchor as a 128-bit hash, for grams in very many places."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("_row", "pos", "kind", "before", "after")]
        for row, pos, kind, before, after in zip(*cols):
            text = before + after
            n = len(text) - LENGTH + 1
            if n < 1:
                continue
            hashes = [hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            starts = pos - len(before) + np.arange(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(np.full(n, row)), pa.array(starts), pa.array(np.full(n, kind, np.int32))],
                ["hash", "_row", "start", "kind"],
            )


def _large_gram_spans(rows: DataFrame) -> DataFrame:
    """Spans of the lone anchors of grams with very many contexts: strings are counted by hash,
    which spreads them over all tasks, and the repeated ones are joined back."""
    strings = stored(rows.mapInArrow(_windows, "hash binary, _row long, start long, kind int").dropDuplicates(["hash", "_row", "start"]), "strings")
    counts = stored(strings.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated")
    return strings.join(counts, "hash").select("_row", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("last"))


def _with_bytes(keyed: DataFrame, probes: DataFrame) -> DataFrame:
    marks = probes.groupBy("_row").agg(F.collect_list(F.struct("gram", "pos", "kind")).alias("marks"))
    return keyed.join(marks, "_row").mapInArrow(_contexts, "gram long, _row long, pos long, kind int, before binary, after binary")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``keyed(_row, text)`` -> (_row, spans ARRAY<STRUCT<first, last>>): byte spans that cover what
    repeated 200-byte strings cover; spans may overlap and reach past a text's ends."""
    spark = keyed.sparkSession
    marks = stored(keyed.mapInArrow(_anchor_rows, "gram long, context long, _row long, pos long"), "anchors")
    ranges = max(shuffle_width(spark), marks.count() // RANGE)
    order = ["gram", "context", "_row", "pos"]
    found = stored(marks.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_compared, SORTED), "sorted")
    known = found.filter(F.col("kind") < OPEN).unionByName(stored(_closed(found.filter(F.col("kind") >= OPEN)), "closed"))
    probes = known.filter(F.col("kind") != INSIDE).select("gram", "_row", "pos", "kind")
    large = stored(probes.groupBy("gram").count().filter(F.col("count") > GROUP).select("gram"), "large")
    tested = (
        _with_bytes(keyed, probes.join(large, "gram", "left_anti"))
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_tested, "_row long, first long, last long")
    )
    inside = known.filter(F.col("kind") == INSIDE)
    inside = inside.select("_row", (F.col("pos") - BEFORE).alias("first"), (F.col("pos") + LENGTH).alias("last"))
    # They lie sorted by (gram, context, row, place), so that in a long run of one string they touch.
    spans = inside.mapInArrow(_touching, SPANS).unionByName(tested)
    if large.limit(1).count():
        spans = spans.unionByName(_large_gram_spans(_with_bytes(keyed, probes.join(large, "gram"))))
    runs = spans.repartition("_row").sortWithinPartitions("_row", "first").mapInArrow(_touching, SPANS)
    return runs.groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


SPANS = "_row long, first long, last long"


def _touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a row that follow each other and touch or overlap as one; those held open at the end
    of a batch wait for the next."""
    held: list[np.ndarray] | None = None

    def out(row, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, first, last)], ["_row", "first", "last"])

    for batch in batches:
        row, first, last = (batch.column(c).to_numpy() for c in ("_row", "first", "last"))
        if held is not None:
            row, first, last = (np.concatenate([h, x]) for h, x in zip(held, (row, first, last)))
        if not len(row):
            continue
        # What is covered up to here in this row: ends only grow inside a row, or a new run begins.
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] < first[:-1])])
        group = np.cumsum(new)
        least = int(min(first.min(), 0))
        size = int(last.max()) - least + 1
        reach = np.maximum.accumulate((last - least) + group * size) - group * size + least
        starts = np.flatnonzero(new | np.concatenate([[True], first[1:] > reach[:-1]]))
        ends = np.append(starts[1:], len(row)) - 1
        row, first, last = row[starts], first[starts], reach[ends]
        yield out(row[:-1], first[:-1], last[:-1])
        held = [row[-1:], first[-1:], last[-1:]]
    if held is not None:
        yield out(*held)


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal ones, inside the text."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((max(0, s["first"]), min(size, s["last"])) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for first, last in spans:
        parts.append(text[at:first])
        at = last
    return b"".join([*parts, text[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
        out: list[list] = [[], [], [], []]
        for text, spans in zip(_utf8(batch.column("text")), batch.column("spans").to_pylist()):
            runs = merged(spans, len(text))
            values = (len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest())
            for x, v in zip(out, values):
                x.append(v)
        cols = [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 3 + [pa.string()])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch], spans: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            old = batch.column("text")
            texts = (kept_bytes(t, merged(s, len(t))).decode(errors="ignore") for t, s in zip(_utf8(old), batch.column(spans).to_pylist()))
            new = pa.array([x if t.is_valid else None for t, x in zip(old, texts)], pa.string())
            names = [n for n in batch.schema.names if n != spans]
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes; null is empty. Every byte covered by a 200-byte string that also
    starts at another place, in any text, is removed; overlaps count. Repeated ids are separate
    rows and separate texts. Texts shorter than 200 bytes lose nothing. Texts of any length are
    read in pieces. An empty table gives an empty result.
    """
    keyed = row_keys(docs.select("doc_id", "text"), unique=unique_ids(docs))
    spans = repeated_spans(keyed.select("_row", "text"))
    schema = fields(docs, "doc_id", "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return keyed.join(spans, "_row", "left").select("doc_id", "text", "spans").mapInArrow(_digests, schema)


def without_repeated_strings(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes removed from text; a character that loses some of its bytes
    goes as a whole. No row is dropped; null texts stay null; other columns stay as they are."""
    name, cuts = free_name(docs, "_row"), free_name(docs, "_spans")
    keyed = row_keys(docs, name)
    spans = repeated_spans(keyed.select(F.col(name).alias("_row"), "text")).select(F.col("_row").alias(name), F.col("spans").alias(cuts))
    kept = keyed.join(spans, name, "left").drop(name)
    return kept.mapInArrow(given_back(partial(_texts, spans=cuts)), docs.schema)
