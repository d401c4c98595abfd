"""Shared beginnings of conversations: double-array tries of shards, and their common upper part.

A turn becomes a token of 20 bytes (16 of the SHA-256 of role and text, 4 with the text's length),
a conversation the string of its tokens, and equal ones one row. Ranges of these strings are the
shards. Each builds a double-array trie over its own dense turn numbers and sums up its nodes.
Nodes that several shards have lie on the paths to their bounds, all above the others; they are
merged by key, and what the shards counted twice is taken back from them and all their ancestors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Bytes of a token, of its hash, and of a node's key.
TOKEN, HASH, KEY = 20, 16, 16
#: A conversation begins like the first of its FAMILY, with at most MOST - 1 of its turns.
FAMILY, MOST = 100, 6
#: Turns of a shard, about; turns that decide where a conversation is dealt.
SHARD, LEADING = 400_000, 8
#: Places tried for a node with several children before it goes behind all others.
TRIES = 32
#: Conversation ids of a chunk on the way to their hash.
CHUNK = 50_000
NODES = "key binary, parent binary, depth long, n long, low long, parent_low long, kids long, leaves long, saved long, size long"


def tokens(role: Column, text: Column) -> Column:
    """20 bytes for a turn; null counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(content, 256), 1, 2 * HASH), F.lpad(F.hex(F.length(text)), 8, "0")))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> conv_id, seq: the tokens in order of turn."""
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", tokens(F.col("role"), F.col("text")).alias("token"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.hex("token").alias("t")))), lambda x: x["t"]), "")
    return turns.groupBy("conv_id").agg(F.unhex(joined).alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first of its family: of ``sequences``
    the same columns. A family has a hundred conversations at most, and five turns are passed on."""
    heads = own.filter(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("head"), F.expr(f"substring(seq, 1, {TOKEN * (MOST - 1)})").alias("start"))
    rows = own.withColumn("head", F.expr(f"conv_id - conv_id % {FAMILY}"))
    rows = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int") * TOKEN)
    return rows.join(heads, "head", "left").select("conv_id", F.expr("concat(coalesce(substring(start, 1, h), x''), substring(seq, h + 1, length(seq)))").alias("seq"))


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot base[s] + c, if check there is s.

    Children are added level by level. Codes start at 0, and slot 0 is the root.
    """

    def __init__(self) -> None:
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -2, np.int64)  # -1 free, -2 the root
        self.used, self.free = 1, 1  # slots in use lie below used; none below free is free

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _open(self, count: int) -> np.ndarray:
        """The first ``count`` free slots."""
        self._grow(self.used + count)
        holes = np.flatnonzero(self.check[self.free : self.used] == -1)[:count] + self.free
        return np.concatenate([holes, np.arange(self.used, self.used + count - len(holes))])

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots of new nodes, given as distinct (parent slot, code) in ascending order."""
        out = np.empty(len(codes), np.int64)
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(np.append(first, len(parents)))
        for i, n in zip(first[counts > 1].tolist(), counts[counts > 1].tolist()):
            out[i : i + n] = self._place(int(parents[i]), codes[i : i + n])
        alone = first[counts == 1]
        slots = self._open(len(alone))
        self.check[slots], self.base[parents[alone]] = parents[alone], slots - codes[alone]
        out[alone] = slots
        if len(slots):
            self.used = max(self.used, int(slots.max()) + 1)
        while self.free < self.used and self.check[self.free] != -1:
            self.free += 1
        return out

    def _place(self, parent: int, codes: np.ndarray) -> np.ndarray:
        span = int(codes[-1] - codes[0]) + 1
        self._grow(self.used + TRIES + span)
        for slot in self._open(TRIES).tolist():
            slots = codes - codes[0] + slot
            self._grow(int(slots[-1]) + 1)
            if (self.check[slots] == -1).all():
                break
        else:
            slots = codes - codes[0] + self.used
            self._grow(int(slots[-1]) + 1)
        self.check[slots], self.base[parent] = parent, slots[0] - codes[0]
        self.used = max(self.used, int(slots[-1]) + 1)
        return slots

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``slots`` by ``codes``, -1 where there is none."""
        to = self.base[slots] + codes
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def build(codes: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of the sequences ``codes[first : first + length]``."""
    trie, at, rows, alphabet = DoubleArray(), np.zeros(len(firsts), np.int64), np.arange(len(firsts)), int(codes.max(initial=0)) + 1
    for d in range(int(lengths.max(initial=0))):
        rows = rows[lengths[rows] > d]
        pairs, inverse = np.unique(at[rows] * alphabet + codes[firsts[rows] + d], return_inverse=True)
        at[rows] = trie.add(pairs // alphabet, pairs % alphabet)[inverse]
    return trie


def shard_nodes(found: list[bytes], copies: np.ndarray, lows: np.ndarray) -> Iterator[dict[str, np.ndarray | list]]:
    """All nodes of one shard, level by level from the deepest, with what the shard knows of each."""
    lengths = np.array([len(x) // TOKEN for x in found], np.int64)
    firsts = np.cumsum(lengths) - lengths
    count = int(lengths.sum())
    data = b"".join(found)
    known = pa.Array.from_buffers(pa.binary(TOKEN), count, [None, pa.py_buffer(data)]).dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    turns = known.dictionary.to_pylist()
    sizes = np.array([int.from_bytes(t[HASH:]) for t in turns], np.int64)
    trie = build(codes, firsts, lengths)
    n, low, key = np.zeros(len(trie.check), np.int64), np.full(len(trie.check), np.iinfo(np.int64).max), {0: hashlib.sha256()}
    levels, own, rows, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.arange(len(found)), np.zeros(len(found), np.int64)
    n[0], low[0] = copies.sum(), lows.min()
    digests = [[key[0].digest()[:KEY]]]
    for d in range(int(lengths.max(initial=0))):
        rows = rows[lengths[rows] > d]
        code = codes[firsts[rows] + d]
        at[rows] = to = trie.step(at[rows], code)
        np.add.at(n, to, copies[rows])
        np.minimum.at(low, to, lows[rows])
        slots, one = np.unique(to, return_index=True)
        above = {}
        for slot, parent, c in zip(slots.tolist(), trie.check[slots].tolist(), code[one].tolist()):
            above[slot] = h = key[parent].copy()
            h.update(turns[c])
        key = above
        levels.append(slots)
        own.append(sizes[code[one]])
        digests.append([h.digest()[:KEY] for h in key.values()])
    kids, leaves, saved = (np.zeros(len(trie.check), np.int64) for _ in range(3))
    for d in range(len(levels) - 1, -1, -1):
        slots = levels[d]
        saved[slots] += (n[slots] - 1) * own[d]
        leaves[slots] += kids[slots] == 0
        parents = trie.check[slots] if d else slots
        if d:
            np.add.at(kids, parents, 1)
            np.add.at(leaves, parents, leaves[slots])
            np.add.at(saved, parents, saved[slots])
            digest = dict(zip(levels[d - 1].tolist(), digests[d - 1]))
        yield {
            "key": digests[d], "parent": [digest[p] for p in parents.tolist()] if d else [None],
            "depth": np.full(len(slots), d), "n": n[slots], "low": low[slots],
            "parent_low": low[parents], "kids": kids[slots], "leaves": leaves[slots], "saved": saved[slots], "size": own[d],
        }


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, copies, lows = [], [], []
    for batch in batches:
        found += batch.column("seq").to_pylist()
        copies.append(batch.column("copies").to_numpy())
        lows.append(batch.column("low").to_numpy())
    if not found:
        return
    kinds = {"key": pa.binary(), "parent": pa.binary()}
    for level in shard_nodes(found, np.concatenate(copies), np.concatenate(lows)):
        for i in range(0, len(level["key"]), 20_000):
            part = {c: pa.array(v[i : i + 20_000], kinds.get(c, pa.int64())) for c, v in level.items()}
            yield pa.RecordBatch.from_pydict(part)


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) -> key, first, ids: comma-joined ids, CHUNK of them at most."""
    key, ids, out = None, [], []

    def flushed(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out and (last or len(out) >= 5000 or sum(len(x["ids"]) for x in out[-3:]) > 1 << 20):
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
            out = []

    def chunk() -> None:
        if ids:
            out.append({"key": key, "first": ids[0], "ids": ",".join(map(str, ids))})

    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or len(ids) == CHUNK:
                chunk()
                yield from flushed(False)
                key, ids = k, []
            ids.append(i)
    chunk()
    yield from flushed(True)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, first) -> key, ends_sha256; one chunk is held at a time."""
    key, state, out = None, None, []
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if state:
                    out.append({"key": key, "ends_sha256": state.hexdigest()})
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if state:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``ends(key, conv_id)`` -> key, ends_sha256 of the ascending ids. Ranges of a key's ids become
    text in as many tasks as needed; only hashing, which has an order, passes through one."""
    width = shuffle_width(ends.sparkSession)
    ordered = ends.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ordered.mapInArrow(_id_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_id_hashes, "key binary, ends_sha256 string")


def _below(shared: DataFrame) -> DataFrame:
    """``shared(key, parent, leaves, saved)``, closed under parents -> key and both summed over the
    node and all below it. Every round adds what lies twice as far below, so rounds grow with the
    logarithm of the depth."""
    now = stored(shared.select("key", F.col("parent").alias("up"), "leaves", "saved"), "below")
    while now.filter("up is not null").limit(1).count():
        adds = now.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jumps = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        more = now.join(adds, "key", "left").join(jumps, "up", "left")
        now = stored(more.select("key", F.col("next").alias("up"), F.expr("leaves + coalesce(l, 0)").alias("leaves"), F.expr("saved + coalesce(s, 0)").alias("saved")), "below")
    return now.drop("up")


def prefix_nodes(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per node of the trie of all rebuilt
    conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are taken by turn, null first; equal turns, which the data should not have, by the digest
    of role and text. Null roles and texts are empty; rows with a null conv_id belong to no
    conversation and are left out. A conversation is rebuilt by ``rebuilt``; one without turns is a
    member of the root only. Ids may be negative; the family then is towards zero, as SQL's ``%``
    has it. Repeated rows are turns of their own. Other columns are not read. An empty table has no
    root. A conversation's tokens, 20 bytes a turn, meet in one row; nothing else is collected.
    """
    own = stored(sequences(conversations), "own-turns")
    whole = stored(rebuilt(own).withColumn("key", F.expr(f"substring(unhex(sha2(seq, 256)), 1, {KEY})")), "rebuilt")
    distinct = whole.groupBy("seq").agg(F.count("*").alias("copies"), F.min("conv_id").alias("low"))
    distinct = stored(distinct.withColumn("lead", F.expr(f"substring(seq, 1, {LEADING * TOKEN})")).withColumn("rest", F.xxhash64("seq")), "distinct")
    turns = distinct.agg(F.sum(F.length("seq"))).first()[0] or 0
    width = max(shuffle_width(own.sparkSession), math.ceil(turns / TOKEN / shard))
    dealt = distinct.repartitionByRange(width, "lead", "rest").select("seq", "copies", "low")
    nodes = stored(dealt.mapInArrow(_shard, NODES), "shard-nodes")
    one = lambda *names: [F.first(c).alias(c) for c in names]  # noqa: E731  equal in all shards
    total = lambda *names: [F.sum(c).alias(c) for c in names]
    merged = nodes.groupBy("key").agg(
        F.count("*").alias("shards"), *one("parent", "depth", "size"), F.min("low").alias("low"), F.min("parent_low").alias("parent_low"),
        *total("n", "kids", "leaves", "saved"), F.count_if(F.col("kids") == 0).alias("bare"),
    )
    merged = stored(merged, "merged")
    shared = merged.filter("shards > 1")
    twice = shared.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("shards") - 1).alias("twice"))
    shared = stored(shared.join(twice, "key", "left").withColumn("kids", F.expr("kids - coalesce(twice, 0)")).drop("twice"), "shared")
    fixes = _below(shared.select("key", "parent", F.expr("if(kids = 0, 1, 0) - bare").alias("leaves"), F.expr("(shards - 1) * size").alias("saved")))
    fixes = fixes.select("key", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    mended = shared.join(fixes, "key").withColumn("leaves", F.expr("leaves + l")).withColumn("saved", F.expr("saved + s")).drop("l", "s")
    rows = merged.filter("shards = 1").unionByName(mended)
    above = shared.select(F.col("key").alias("parent"), F.col("low").alias("shared_low"))
    rows = rows.join(above, "parent", "left").join(end_hashes(whole.select("key", "conv_id")), "key", "left")
    return rows.select(
        F.col("low").alias("conv_id"), "depth", F.expr("if(depth = 0, null, coalesce(shared_low, parent_low))").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
