"""Token ids in files: fixed-size blocks, transposed into byte or bit planes, zstandard on each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolweave.session import scratch_path

from .common import given_back, shuffle_width, slices
from .tokens import default_path, word_tokenizer

#: Ids of a block.
BLOCK = 1 << 16
END_ID = 0
LEVEL = 3


def planes_of(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """A block of ids as planes, lowest first: one byte, or one bit, of every id each. Planes above
    the highest one that is used are left out."""
    raw = np.ascontiguousarray(ids, "<u4")
    if bits:
        used = max(1, int(raw.max(initial=0)).bit_length())
        rows = [np.packbits((raw >> b & 1).astype(np.uint8)) for b in range(used)]
    else:
        used = max(1, (int(raw.max(initial=0)).bit_length() + 7) // 8)
        rows = list(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T[:used]))
    pack = zstandard.ZstdCompressor(level=LEVEL)
    return [pack.compress(r.tobytes()) for r in rows]


def ids_of(planes: list[bytes], count: int, bits: bool = False) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    out = np.zeros(count, np.uint32)
    for i, plane in enumerate(planes):
        size = (count + 7) // 8 if bits else count
        row = np.frombuffer(unpack.decompress(plane, max_output_size=max(1, size)), np.uint8)
        row = np.unpackbits(row, count=count) if bits else row
        out |= row.astype(np.uint32) << np.uint32(i if bits else 8 * i)
    return out


ROW = "part int, position long, counts array<long>, blocks array<struct<count: long, planes: array<binary>>>"
BLOCKS = pa.list_(pa.struct([("count", pa.int64()), ("planes", pa.list_(pa.binary()))]))
#: Bytes of text of a part. A row ends with the document that fills a block: small rows, since Spark
#: holds each in one piece.
PART = 64 << 20


def _files(batches: Iterator[pa.RecordBatch], path: str, bits: bool) -> Iterator[pa.RecordBatch]:
    """Sorted documents -> rows of the file of this partition."""
    part, tokenizer = TaskContext.get().partitionId(), word_tokenizer(path)
    names: list = []
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    written = held = 0
    kind = pa.int64()

    def row() -> pa.RecordBatch:
        nonlocal names, ids, counts, written, held
        all_ids = np.concatenate(ids)
        blocks = [all_ids[i : i + BLOCK] for i in range(0, held, BLOCK)]
        planes = [{"count": len(b), "planes": planes_of(b, bits)} for b in blocks]
        columns = [pa.array([names], pa.list_(kind)), pa.array([part], pa.int32()), pa.array([written], pa.int64())]
        columns += [pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())), pa.array([planes], BLOCKS)]
        names, ids, counts, written, held = [], [], [], written + held, 0
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "part", "position", "counts", "blocks"])

    for whole in batches:
        kind = whole.schema.field("doc_id").type
        for batch in slices(whole, "text", 2 << 20):
            found, sizes = tokenizer.encode_flat(batch.column("text").to_pylist(), END_ID)
            docs, ends = batch.column("doc_id").to_pylist(), np.cumsum(sizes)
            first = 0
            while first < len(docs):  # a row ends with the first document that fills it
                done = int(ends[first - 1]) if first else 0
                stop = min(len(docs), int(np.searchsorted(ends, done + BLOCK - held)) + 1)
                names += docs[first:stop]
                counts.append(sizes[first:stop])
                ids.append(found[done : ends[stop - 1]])
                held += int(ends[stop - 1]) - done
                if held >= BLOCK:
                    yield row()
                first = stop
    if names:
        yield row()


def write_ids(docs: DataFrame, target: str, path: str | None = None, bits: bool = False) -> None:
    """Write the token ids of ``docs(doc_id, text)`` below ``target`` in ascending doc_id order.

    Range partitioning by doc_id numbers the parts in that order; there are as many as the texts'
    bytes ask for, and each is a file of its own. A row of a file has some whole documents: their
    ids and counts, the position of their first token id in the part, and the token ids as
    compressed planes of fixed-size blocks, the last one shorter. So any row can be read alone, and
    the columns without the planes are the chunk index. Spark's writer commits the files, so a lost
    executor leaves no half part. Null and empty texts are the end id alone; null ids come first;
    rows that repeat an id follow each other.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), -(-size // PART))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ordered.mapInArrow(given_back(partial(_files, path=path or default_path(), bits=bits)), f"doc_ids array<{kind}>, {ROW}")
    rows.write.option("maxRecordsPerFile", 0).parquet(target)


def _read(batches: Iterator[pa.RecordBatch], bits: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the files -> their documents."""
    for batch in batches:
        kind = batch.schema.field("doc_ids").type.value_type
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            part, position, blocks = (row.column(c)[0].as_py() for c in ("part", "position", "blocks"))
            counts = np.array(row.column("counts")[0].as_py(), np.int64)
            ids = np.concatenate([ids_of(b["planes"], b["count"], bits) for b in blocks]) if blocks else np.empty(0, np.uint32)
            ends = np.cumsum(counts)
            if ends[-1] != len(ids):
                raise ValueError(f"part {part} has {len(ids)} ids at {position}, its index {ends[-1]}")
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            starts = ends - counts
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            docs = row.column("doc_ids").flatten().cast(kind)
            columns = [docs, pa.array([part] * len(docs), pa.int32()), *(pa.array(c, pa.int64()) for c in (starts + position, counts, sums))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "position", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, source: str, bits: bool = False, id_type: str = "long") -> DataFrame:
    """Files of ``write_ids`` -> doc_id, start, n_tokens, ids_crc32: the ids are decoded from the
    planes; start counts the ids of all documents before. Rows are read where they lie: there is no
    shuffle, and only the number of ids of each file is collected, from the chunk index."""
    rows = spark.read.schema(f"doc_ids array<{id_type}>, {ROW}").parquet(source)
    sizes = rows.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    at, bases = 0, []
    for r in sizes.orderBy("part").collect():  # a row for each file
        bases.append((r.part, at))
        at += r.n
    base = spark.createDataFrame(bases, "part int, base long")
    found = rows.mapInArrow(given_back(partial(_read, bits=bits)), f"doc_id {id_type}, part int, position long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def stored_ids(docs: DataFrame, path: str | None = None, bits: bool = False) -> DataFrame:
    """Write the ids to the shared scratch folder and read them back."""
    target = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, target, path, bits)
    return read_ids(docs.sparkSession, target, bits, docs.schema["doc_id"].dataType.simpleString())
