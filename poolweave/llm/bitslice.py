"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an index block, queries of a query block, and bits kept of a component and of a weight.
ROWS, QUERIES, SLICES, WEIGHT_BITS = 16_384, 256, 6, 8
SCALE, EVERY = 256, 50
#: Below this a double's floor is exact in 64 bits; vectors with larger components, and inner
#: products that may pass WIDE, are worked out with Python's integers.
EXACT, WIDE, LONGEST = 1 << 53, 1 << 62, (1 << 63) - 1


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64, or Python's integers where one is too large."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < EXACT:
        return y.astype(np.int64)
    out = np.array([floor(Fraction(v) * scale) for v in x.ravel().tolist()], object)
    return out.reshape(x.shape)


def _most(values: np.ndarray) -> int:
    return max((abs(int(v)) for v in (values.min(), values.max())), default=0) if values.size else 0


def _products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with a query."""
    if values.dtype == object or query.dtype == object or values.shape[1] * _most(values) * _most(query) >= WIDE:
        return values.astype(object) @ query.astype(object) if values.shape[1] else np.zeros(len(values), object)
    return values @ query


class SlicedBlock:
    """Integer vectors of one block: for each attribute (component) the bitmaps of its quantised
    values, highest bits only, and the exact values for the rows in question."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        low = values.min(axis=0, initial=0) if len(values) else np.zeros(values.shape[1], np.int64)
        high = values.max(axis=0, initial=0) if len(values) else low
        span = int((high - low).max(initial=0))
        self.low, self.cut = low, max(0, span.bit_length() - SLICES)
        codes = ((values - low) >> self.cut).astype(np.int64)
        n = len(ids)
        self.bytes = -(-n // 64) * 8
        # [attributes, slices, words]: bit r of a bitmap belongs to row r.
        self.slices = np.zeros((values.shape[1], SLICES, self.bytes), np.uint8)
        for s in range(SLICES):
            bits = np.packbits((codes.T >> s & 1).astype(np.uint8), axis=1, bitorder="little")
            self.slices[:, s, : bits.shape[1]] = bits
        self.slices = self.slices.view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, lowest first, of sum(weight * code) over attributes with weights >= 0: every bit
        of a weight adds the attribute's slices one place further up, by carry-save addition."""
        columns: dict[int, list[np.ndarray]] = {}
        for bit in range(int(weights.max(initial=0)).bit_length()):
            at = np.flatnonzero(weights >> bit & 1)
            for s in range(SLICES):
                columns.setdefault(bit + s, []).append(self.slices[at, s])
        out, place = [], 0
        while columns:
            parts = columns.pop(place, [])
            rows = np.concatenate(parts) if parts else np.empty((0, self.slices.shape[2]), np.uint64)
            while len(rows) > 1:
                # Three bitmaps become a sum here and a carry one place up; of two, the third is 0.
                n = len(rows) // 3 or 1
                a, b = rows[:n], rows[n : 2 * n]
                c = rows[2 * n : 3 * n] if len(rows) > 2 else np.zeros_like(a)
                ab = a ^ b
                columns.setdefault(place + 1, []).append((a & b) | (ab & c))
                rows = np.concatenate([ab ^ c, rows[3 * n :]])
            out.append(rows[0] if len(rows) else np.zeros(self.slices.shape[2], np.uint64))
            place += 1
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Row numbers among which the k best of this block are, all ties included."""
        n = len(self.ids)
        if n <= k:
            return np.arange(n)
        # Score = sum of query * low + 2^cut * (query * code) + query * rest, rest in [0, 2^cut).
        # Codes are complemented where the weight is negative, so all terms are >= 0.
        size = np.abs(query)
        shift = max(0, int(size.max(initial=0)).bit_length() - WEIGHT_BITS)
        weights = (size >> shift).astype(np.int64)
        negative = (query < 0).astype(bool)
        index = self if not negative.any() else self._complemented(negative)
        planes = index.sums(weights)
        # What the kept bits leave open: the bits of the weights and of the values that were cut.
        top = (1 << SLICES) - 1
        total, kept = sum(size.tolist()), sum(weights.tolist()) << shift
        slack = ((total - kept) * top << self.cut) + total * ((1 << self.cut) - 1)
        unit = 1 << (shift + self.cut)
        kth = self._kth(planes, k)
        least = kth - slack // unit - 1
        return self._at_least(planes, least)

    def _complemented(self, negative: np.ndarray) -> "SlicedBlock":
        other = object.__new__(SlicedBlock)
        other.ids, other.values, other.low, other.cut, other.bytes = self.ids, self.values, self.low, self.cut, self.bytes
        flip = np.where(negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        other.slices = self.slices ^ flip[:, None, None]
        return other

    def _real(self) -> np.ndarray:
        """The bitmap of rows that exist."""
        bits = np.zeros(self.bytes * 8, np.uint8)
        bits[: len(self.ids)] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def _kth(self, planes: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, bit by bit from the most significant slice down."""
        rest, value, need = self._real(), 0, k
        for place in range(len(planes) - 1, -1, -1):
            ones = rest & planes[place]
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                rest, value = ones, value | 1 << place
            else:
                need -= count
                rest = rest & ~planes[place]
        return value

    def _at_least(self, planes: list[np.ndarray], least: int) -> np.ndarray:
        """Row numbers whose sum is at least ``least``, again from the top slice down."""
        rest, above = self._real(), np.zeros(self.bytes // 8, np.uint64)
        if least > 0:
            if least >> len(planes):
                return np.empty(0, np.int64)
            for place in range(len(planes) - 1, -1, -1):
                if least >> place & 1:
                    rest = rest & planes[place]
                else:
                    above |= rest & planes[place]
                    rest = rest & ~planes[place]
        return np.flatnonzero(np.unpackbits((above | rest).view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows besides ``own``: largest score, then smallest id."""
        extra = int(np.count_nonzero(self.ids == own))
        at = self.candidates(query, k + extra)
        at = at[self.ids[at] != own]
        scores = _products(self.values[at], query)
        if scores.dtype == object:
            order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
        else:
            order = np.lexsort([self.ids[at], -scores])[:k]
        return self.ids[at][order], scores[order]


def _unpacked(kind: str, data: bytes, scale: int) -> np.ndarray:
    values = np.frombuffer(data, kind)
    return _floors(values, scale) if kind == "<f8" else values.astype(np.int64)


def _block_best(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Pairs of an index block and a query block -> the k best rows of the block for each query.
    Rows come sorted by block, so its slices are built once for all query blocks that follow."""
    known, block = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            values = {c: batch.column(c)[row].as_py() for c in ("dim", "block", "ids", "kind", "values", "query_ids", "query_kind", "query_values")}
            at = values["dim"], values["block"]
            if at != known:
                known = at
                own_ids = np.frombuffer(values["ids"], np.int64)
                block = SlicedBlock(own_ids, _unpacked(values["kind"], values["values"], scale).reshape(len(own_ids), values["dim"]))
            asked = np.frombuffer(values["query_ids"], np.int64)
            queries = _unpacked(values["query_kind"], values["query_values"], scale).reshape(len(asked), values["dim"])
            for own, query in zip(asked, queries):
                ids, scores = block.best(query, int(own), k)
                shown = [max(-LONGEST - 1, min(LONGEST, s)) for s in scores.tolist()]
                cols = [pa.array(np.full(len(ids), own)), pa.array(ids), pa.array(shown, pa.int64()), pa.array([str(s) if abs(s) >= LONGEST else None for s in scores.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score", "exact"])


def _packer(prefix: str, block: str, scale: int):
    return lambda table: _packed(table, prefix, block, scale)


def _packed(table: pa.Table, prefix: str, block: str, scale: int) -> pa.Table:
    """Vectors of one block as two byte strings: the integers in the narrowest type that holds them,
    or the doubles they come from where they pass EXACT."""
    dim, number = table.column("dim")[0].as_py(), table.column(block)[0].as_py()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    ids = table.column("id").to_numpy()[order]
    flat = table.column("v").combine_chunks()
    x = flat.flatten().to_numpy().reshape(-1, dim)[order] if dim else np.empty((len(ids), 0))
    values = _floors(x, scale)
    most = _most(values)
    kind = "<f8" if values.dtype == object else next(f"<i{b}" for b in (2, 4, 8) if most < 1 << (8 * b - 1))
    data = np.ascontiguousarray(x if kind == "<f8" else values, kind).tobytes()
    return pa.table({"dim": [dim], block: [number], f"{prefix}ids": [ids.astype(np.int64).tobytes()], f"{prefix}kind": [kind], f"{prefix}values": [data]})


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> (id, dim, v ARRAY<DOUBLE>) of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    values = F.transform(x, lambda e: e.cast("double"))
    return vectors.filter("vec_id is not null and embedding is not null").filter(whole).select(
        F.col("vec_id").cast("long").alias("id"), F.size(x).cast("long").alias("dim"), values.alias("v")
    )


def _floor(scale: int, e):
    """floor(scale * e) as a double, for any size."""
    y = F.lit(float(scale)) * e
    return F.when(F.abs(y) < float(EXACT), F.floor(y).cast("double")).otherwise(y)


def nearest(vectors: DataFrame, k: int = 5, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by ``every`` its ``k``
    highest integer inner products with all other rows, ties to the smaller vec_id.

    Components become floor(scale * x). Vectors that are null, hold null or non-finite components,
    or have no id take no part; vectors of other lengths than the query's are not compared with it.
    Rows that repeat an id are candidates each, but never for a query with that id; of the vectors
    of a repeated query id the smallest one asks. Components may have any finite size: ranks come
    from exact integers, and a score beyond 64 bits shows as the nearest long. A query without
    candidates has no row; an empty table gives an empty result.

    Rows are cut into index blocks and queries into query blocks by hashed id; every query block
    meets every index block. A block finds its k best from the slices, and the few rows that the
    bits kept cannot decide are scored exactly. Only k rows per query and block are shuffled.
    """
    rows = whole_vectors(vectors)
    blocks = "dim long, {0} long, {1}ids binary, {1}kind string, {1}values binary"
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / ROWS).alias("blocks"),
        F.greatest(F.ceil(F.count_if(F.col("id") % every == 0) / QUERIES), F.lit(1)).alias("query_blocks"),
    )
    # One row for each length of a vector, which is no more than the longest vector has components.
    spread = rows.join(F.broadcast(sizes), "dim")
    index = (
        spread.withColumn("block", F.pmod(F.xxhash64("id", "v"), "blocks"))
        .groupBy("dim", "block")
        .applyInArrow(_packer("", "block", scale), blocks.format("block", ""))
    )
    asked = (
        spread.filter(F.col("id") % every == 0)
        .groupBy("id")
        .agg(F.min(F.struct("dim", F.transform("v", lambda e: _floor(scale, e)).alias("order"), "v", "query_blocks")).alias("q"))
        .select("id", "q.dim", "q.v", "q.query_blocks")
        .withColumn("query_block", F.pmod(F.xxhash64("id"), "query_blocks"))
        .groupBy("dim", "query_block")
        .applyInArrow(_packer("query_", "query_block", scale), blocks.format("query_block", "query_"))
    )
    pairs = asked.join(F.broadcast(sizes.select("dim", "blocks")), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = index.join(pairs.drop("blocks"), ["dim", "block"]).sortWithinPartitions("dim", "block")
    found = met.mapInArrow(partial(_block_best, k=k, scale=scale), "query_id long, vec_id long, score long, exact string")
    # Scores beyond 64 bits are ordered by their digits: more of them, then larger ones; negative
    # numbers the other way round.
    digits, below = F.coalesce(F.col("exact"), F.lit("")), F.col("score") < 0
    size = F.when(below, -F.length(digits)).otherwise(F.length(digits))
    order = [F.desc("score"), F.desc(size), F.when(~below, digits).desc_nulls_last(), F.when(below, digits).asc_nulls_last(), "vec_id"]
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
