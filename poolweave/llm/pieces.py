"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import fields, slices

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, USER, UNUSED, BYTE = 1, 4, 5, 6
#: Words longer than this are segmented each time; so many are remembered in a Python worker.
LONGEST, REMEMBERED = 48, 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Segmentation with the highest sum of piece scores.

    Every character outside all pieces costs ten more than the lowest score and becomes its UTF-8
    bytes. Among equal sums the longest last piece wins, at every position. Where no piece has a
    space mark behind another character, texts fall apart before their runs of space marks, and
    the words in between are segmented once each.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        usable = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.unknown = min(s for _, _, s in usable) - 10
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in usable:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.apart = not any(SPACE in p.lstrip(SPACE) for _, p, _ in usable)
        self.known: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of one stretch of text, by relaxing the best score at each position with all pieces
        that end there; the automaton's output links give them in one pass over the text."""
        n = len(text)
        # best[e]: highest score of text[:e], back[e]: (start, id) of its last piece.
        best, back, done = [0.0] * (n + 1), [(0, -1)] * (n + 1), 0

        def settle(upto: int) -> None:
            """Positions that no piece ends at, up to the one that is looked at now."""
            nonlocal done
            while done < upto:
                done += 1
                best[done], back[done] = best[done - 1] + self.unknown, (done - 1, -1)

        for last, (size, score, piece) in self.automaton.iter(text):
            end = last + 1
            settle(end)
            start = end - size
            value = best[start] + score
            if value > best[end] or value == best[end] and start < back[end][0]:
                best[end], back[end] = value, (start, piece)
        settle(n)
        out, end = [], n
        while end:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in reversed(text[start:end].encode())]
            end = start
        return out[::-1]

    def _words(self, text: str) -> list[str]:
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.apart:
            return [marked]
        if SPACE + SPACE not in marked:
            first, *others = marked.split(SPACE)
            return ([first] if first else []) + [SPACE + w for w in others]
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids; none for null and empty texts."""
        if not text:
            return np.empty(0, "<u4")
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in self._words(text):
            ids = known.get(word)
            if ids is None:
                ids = array("I", self.segment(word)).tobytes()
                if len(word) <= LONGEST:
                    known[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: space marks become spaces, runs of byte pieces become characters."""
        out = bytearray()
        for i in ids.tolist():
            out += bytes((self.values[i],)) if i in self.values else self.names[i].encode()
        text = out.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            ids = [model.encode(t.as_py()) for t in batch.column("text")]
            same = [model.decode(x) == (t.as_py() or "").replace(SPACE, " ") for x, t in zip(ids, batch.column("text"))]
            sizes = pa.array([len(x) for x in ids], pa.int64())
            lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            sums = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, sizes, sums, pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, ids, n_ids, ids_crc32, round_trip (whether decoding gives
    the text back; U+2581 itself comes back as a space).

    Null and empty texts have no ids. Repeated and null ids are rows like others; other columns are
    not read; an empty table gives an empty result.
    """
    schema = fields(docs, "doc_id", "ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, path=path or default_path()), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encoded(docs, path).select("doc_id", "n_ids", "ids_crc32", F.col("round_trip"))
