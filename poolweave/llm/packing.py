"""Packing token streams into sequences: cuts by dynamic programming, in the order of the rows."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import fields, given_back, slices
from .tokens import default_path, sentence_ends, word_tokenizer

LENGTH = 2048
#: What a cut costs, in tokens of padding: at a sentence end inside a document, and elsewhere.
SENTENCE, FORCED = 2, 8
#: Gaps between document and sentence ends in which cuts are forced, and how far these are apart.
GAP, STEP = 16, 8
#: Tokens among which cuts are chosen at once, so that they are the best ones of that stretch; its
#: last sequence moves on to the next.
STRETCH = 1 << 20
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Cuts among ascending ``places`` (the first is the start, the last the end) that minimise
    padding plus penalties; neighbours are at most ``length`` apart.

    cost[j] = min over i with places[j] - places[i] <= length of
    cost[i] + length - (places[j] - places[i]) + penalties[j]. With cost[i] + places[i] kept in an
    ascending queue, every place enters and leaves once.
    """
    at, fines = places.tolist(), penalties.tolist()
    before = [0] * len(at)
    queue = deque([(at[0], 0)])  # (cost + place, index), ascending
    for j in range(1, len(at)):
        place = at[j]
        while at[queue[0][1]] < place - length:
            queue.popleft()
        low, before[j] = queue[0]
        value = low + length + fines[j]  # cost[j] + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return [at[i] for i in reversed(cuts)]


def cut_places(ids: np.ndarray, ends: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may be, and their penalties: document ends, sentence ends, and in gaps of more than
    GAP tokens between those every STEP tokens, which only pays where the next end leaves more room
    than FORCED."""
    size = len(ids)
    free = np.zeros(size + 1, bool)
    free[np.flatnonzero(last[ids]) + 1] = True
    free[ends] = free[0] = free[size] = True
    places = np.flatnonzero(free)
    fines = np.full(len(places), SENTENCE)
    fines[np.isin(places, ends, assume_unique=False)] = fines[0] = fines[-1] = 0
    gaps = np.diff(places)
    step = min(STEP, length)
    count = np.where(gaps > min(GAP, length), (gaps - 1) // step, 0)
    if count.any():
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        places = np.concatenate([places, np.repeat(places[:-1], count) + number * step])
        fines = np.concatenate([fines, np.full(len(number), FORCED)])
        order = np.argsort(places, kind="stable")
        places, fines = places[order], fines[order]
    return places, fines


def powers(size: int) -> list[int]:
    """Sizes of sequences for what is left at the end of a stream: powers of two need no padding."""
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


class Packer:
    """Documents in, pieces out; holds one stretch of tokens and a batch of documents at most."""

    def __init__(self, first_sequence: int, last: np.ndarray, length: int = LENGTH, stretch: int = STRETCH) -> None:
        self.sequence, self.last, self.length, self.stretch = first_sequence, last, length, stretch
        self.names: list = []  # of the documents held
        self.ids, self.sizes = [], []
        self.held, self.done = 0, 0  # ids held; ids of the first document that are packed already

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """One document -> the pieces that are settled by it."""
        return list(zip(*self.add_all([doc_id], ids, np.array([len(ids)]))))

    def close(self) -> list[tuple]:
        return list(zip(*self.close_all()))

    def add_all(self, names: list, ids: np.ndarray, counts: np.ndarray) -> list[list]:
        """Documents with their ids one after the other -> columns of pieces, as in PIECES."""
        self.names += names
        self.ids.append(ids)
        self.sizes.append(counts)
        self.held += len(ids)
        return self._packed(False) if self.held >= self.stretch else []

    def close_all(self) -> list[list]:
        return self._packed(True) if self.held else []

    def _packed(self, final: bool) -> list[list]:
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        left = sizes.copy()
        left[0] -= self.done
        ends = np.cumsum(left)
        cuts = best_cuts(*cut_places(ids, ends, self.last, self.length), self.length)
        if not final:
            cuts = cuts[:-1]
        else:
            tail = cuts.pop() - cuts[-1]
            cuts += (cuts[-1] + np.cumsum([tail] if tail == self.length else powers(tail))).tolist()
        at = np.array(cuts)
        begins = np.unique(np.concatenate([at, ends[ends < at[-1]]]))
        firsts, stops = begins[:-1], begins[1:]
        document, sequence = np.searchsorted(ends, firsts, "right"), np.searchsorted(at, firsts, "right") - 1
        start = firsts - np.append(0, ends)[document] + np.where(document == 0, self.done, 0)
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), stops.tolist())]
        out = [[self.names[d] for d in document.tolist()], start, stops - firsts, sums, sizes[document], self.sequence + sequence, firsts - at[sequence]]
        self.sequence += len(cuts) - 1
        d = int(np.searchsorted(ends, at[-1], "right"))  # the first document that is not packed whole
        self.done = int(at[-1] - np.append(0, ends)[d] + (self.done if d == 0 else 0)) if d < len(ends) else 0
        self.names, self.ids, self.sizes, self.held = self.names[d:], [ids[at[-1] :].copy()], [sizes[d:]], len(ids) - int(at[-1])
        return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId() << 32, sentence_ends(path), length)
    tokenizer = word_tokenizer(path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = pa.int64()

    def rows(found: list[list]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], kind), *(pa.array(c, pa.int64()) for c in found[1:])], names)

    for whole in batches:
        kind = whole.schema.field("doc_id").type
        for batch in slices(whole, "text", 2 << 20):
            ids, counts = tokenizer.encode_flat(batch.column("text").to_pylist(), END_ID)
            yield from rows(packer.add_all(batch.column("doc_id").to_pylist(), ids, counts))
    yield from rows(packer.close_all())


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``docs(doc_id, text)`` -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    Each partition packs its documents in their order, without a shuffle; sequence ids carry the
    partition's number. A document's ids end with id 1; null and empty texts are that id alone.
    Every id lies in one piece. A sequence has at most ``length`` ids, and its offsets have no gap.
    Cuts fall on document ends, else on sentence ends, and elsewhere only in gaps of more than GAP
    ids, where that saves more than FORCED ids of padding. They are the best ones of each stretch of
    STRETCH ids of a partition, not of the table. What remains at the end of a partition is cut into powers of two, which need
    no padding. Repeated and null ids are documents like others. Other columns are not read. An
    empty table gives an empty result.
    """
    pick = partial(_pieces, path=path or default_path(), length=length)
    return docs.select("doc_id", "text").mapInArrow(given_back(pick), fields(docs, "doc_id", PIECES))
