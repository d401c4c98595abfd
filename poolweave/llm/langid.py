"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, given_back, slices

#: Bytes that the network reads at once; its state starts anew in each such stretch.
SPAN = 64
HIDDEN, EPOCHS, BATCH, RATE = 12, 8, 256, 0.01
#: The sample the network learns from: documents of each language, fewer of each where there are more
#: than LANGUAGES, and stretches of each document.
LANGUAGES, DOCUMENTS, STRETCHES = 64, 700, 8
UNKNOWN = "und"
#: Hashed ids are taken modulo this.
WHOLE = 1 << 30


@dataclass
class Direction:
    """One direction of the network. Gates are update, reset and candidate, ``inputs`` has a row for
    each byte. Sigmoid and tanh are their piecewise linear forms."""

    inputs: np.ndarray  # [256, 3 H]
    states: np.ndarray  # [3 H, H]
    read: np.ndarray  # [C, H]

    @classmethod
    def random(cls, hidden: int, classes: int, rng: np.random.Generator) -> "Direction":
        def draw(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        inputs = draw(0.5, 256, 3 * hidden)
        inputs[:, :hidden] += 1  # remember at first
        return cls(inputs, draw(0.5 / np.sqrt(hidden), 3 * hidden, hidden), draw(0.5, classes, hidden))

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates, candidate, recurrent part of the candidate); arrays are [rows, texts]."""
        h = len(state)
        x = np.take(self.inputs, codes, axis=0).T.copy()
        g = self.states @ state
        gates = x[: 2 * h]
        gates += g[: 2 * h]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        recurrent = g[2 * h :]
        candidate = recurrent * gates[h:]
        candidate += x[2 * h :]
        np.clip(candidate, -1, 1, out=candidate)
        new = state - candidate
        new *= gates[:h]
        new += candidate
        return new, gates, candidate, recurrent

    def run(self, codes: np.ndarray, real: np.ndarray | None, back: bool) -> Iterator[tuple[int, np.ndarray]]:
        """States at every position; ``real`` [positions, texts] is 0 where a text has ended."""
        state = np.zeros((self.states.shape[1], codes.shape[1]), np.float32)
        for t in range(len(codes))[:: -1 if back else 1]:
            state = self.step(state, codes[t])[0]
            if real is not None:
                state *= real[t]
            yield t, state


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def probabilities(self, codes: np.ndarray, weights: np.ndarray | None = None, real: np.ndarray | None = None) -> np.ndarray:
        """[classes, texts]: sums of the probabilities of all positions, each labelled from what
        stands before and after it. codes: [positions, texts]."""
        later = np.empty((len(codes), len(self.bias), codes.shape[1]), np.float32)
        for t, state in self.backward.run(codes, real, True):
            np.matmul(self.backward.read, state, out=later[t])
        total = np.zeros((len(self.bias), codes.shape[1]), np.float32)
        for t, state in self.forward.run(codes, real, False):
            x = self.forward.read @ state
            x += later[t]
            x += self.bias[:, None]
            x = _softmax(x)
            total += x if weights is None else x * weights[t]
        return total

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of all positions and its gradients, by backpropagation through time."""
        span, n = codes.shape
        record: dict[bool, list] = {}
        for back, way in ((False, self.forward), (True, self.backward)):
            state, steps = np.zeros((way.states.shape[1], n), np.float32), [None] * span
            for t in range(span)[:: -1 if back else 1]:
                new, *rest = way.step(state, codes[t])
                steps[t] = (state, new, *rest)
                state = new
            record[back] = steps
        loss, errors = 0.0, np.empty((span, len(self.bias), n), np.float32)
        for t in range(span):
            x = self.forward.read @ record[False][t][1] + self.backward.read @ record[True][t][1] + self.bias[:, None]
            p = _softmax(x)
            loss -= float(np.log(p[labels, np.arange(n)] + 1e-9).sum())
            p[labels, np.arange(n)] -= 1
            errors[t] = p / (span * n)
        grads: list[np.ndarray] = []
        for back, way in ((False, self.forward), (True, self.backward)):
            h = way.states.shape[1]
            d_in, d_states, d_read = (np.zeros_like(a) for a in (way.inputs, way.states, way.read))
            flow = np.zeros((h, n), np.float32)
            for t in range(span)[:: 1 if back else -1]:
                state, new, gates, candidate, recurrent = record[back][t]
                d_read += errors[t] @ new.T
                flow = flow + way.read.T @ errors[t]
                update, reset = gates[:h], gates[h:]
                d_candidate = flow * (1 - update) * (np.abs(candidate) < 1)
                d_update = flow * (state - candidate) * ((update > 0) & (update < 1)) * 0.25
                d_reset = d_candidate * recurrent * ((reset > 0) & (reset < 1)) * 0.25
                d_g = np.concatenate([d_update, d_reset, d_candidate * reset])
                d_x = np.concatenate([d_update, d_reset, d_candidate])
                np.add.at(d_in, codes[t], d_x.T)
                d_states += d_g @ state.T
                flow = flow * update + way.states.T @ d_g
            grads += [d_in, d_states, d_read]
        return loss / (span * n), [*grads, errors.sum(axis=(0, 2))]

    def parameters(self) -> list[np.ndarray]:
        return [a for way in (self.forward, self.backward) for a in (way.inputs, way.states, way.read)] + [self.bias]


def trained(stretches: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the cross entropy of positions. stretches: [n, SPAN] bytes; labels: indices."""
    rng = np.random.default_rng(seed)
    net = Network(languages, *(Direction.random(hidden, len(languages), rng) for _ in range(2)), np.zeros(len(languages), np.float32))
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    steps, total = 0, epochs * -(-len(labels) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            _, grads = net.gradients(np.ascontiguousarray(stretches[at].T), labels[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            steps += 1
            rate = RATE * min(1.0, 2 * (1 - (steps - 1) / total))
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def _stretches(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """Evenly spread stretches of a document, cut or repeated to SPAN bytes."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for lang, order, text in zip(batch.column("lang").to_pylist(), batch.column("_order").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            text = text if len(text) >= SPAN else (text * SPAN)[:SPAN]
            for s in np.unique(np.linspace(0, len(text) - SPAN, count).astype(int)):
                for x, v in zip(out, (lang, order, text[s : s + SPAN])):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.binary()))], ["lang", "_order", "piece"])


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def _sampled(known: DataFrame, shares: Column, most: int) -> list:
    """At most ``most`` stretches of the documents whose hashed id is below ``shares`` of their lang."""
    order = F.xxhash64("doc_id")
    chosen = known.filter((F.pmod(order, F.lit(WHOLE)) < shares) & F.col("text").rlike(r"\p{L}")).withColumn("_order", order)
    chosen = chosen.select("lang", "_order", "text").mapInArrow(partial(_stretches, count=STRETCHES), "lang string, _order long, piece binary")
    return chosen.orderBy(F.pmod("_order", F.lit(WHOLE)), "_order", "piece").limit(most).collect()


def _one_of_each(known: DataFrame, names: list[str]) -> list:
    """Stretches of the document of each of ``names`` with text and the smallest hashed id."""
    some = known.filter(F.col("lang").isin(names) & F.col("text").rlike(r"\p{L}")).withColumn("_order", F.xxhash64("doc_id"))
    first = some.groupBy("lang").agg(F.min("_order").alias("_order"), F.min_by(F.substring("text", 1, 64 * SPAN), "_order").alias("text"))
    return first.mapInArrow(partial(_stretches, count=STRETCHES), "lang string, _order long, piece binary").orderBy("lang", "_order", "piece").collect()


def fit(docs: DataFrame, documents: int = DOCUMENTS, languages: int = LANGUAGES, **options) -> Network | None:
    """Train on a bounded sample: of every value of lang the ``documents`` documents with the smallest
    hashed ids, among those with text and lang whose crc32(doc_id) mod 4 is not 2; beyond ``languages``
    values fewer of each, so that there are ``languages`` times ``documents`` in all, but one at least
    of every value that has a text with a letter. None if there is no such document."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (_remainder() != 2))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    documents = max(1, min(documents, documents * languages // len(counts)))
    shares = [F.lit(x) for r in counts for x in (r.lang, min(WHOLE, int(WHOLE * 1.3 * documents / r["count"]) + 1))]
    rows = _sampled(known, F.element_at(F.create_map(*shares), F.col("lang")), 2 * documents * STRETCHES * len(counts))
    missed = sorted({r.lang for r in counts} - {r.lang for r in rows})
    if missed:
        rows += _one_of_each(known, missed)
    names = sorted({r.lang for r in rows})
    if not names:
        return None
    number = {n: i for i, n in enumerate(names)}
    taken: dict[str, set] = {n: set() for n in names}
    pieces, labels = [], []
    for r in rows:
        if r._order in taken[r.lang] or len(taken[r.lang]) < documents:
            taken[r.lang].add(r._order)
            pieces.append(np.frombuffer(bytes(r.piece), np.uint8))
            labels.append(number[r.lang])
    return trained(np.array(pieces), np.array(labels), names, **options)


def label_documents(texts: list[bytes], net: Network, block: int = 4096) -> np.ndarray:
    """[texts, classes]: mean probabilities over all bytes of each text, which has one at least. With
    more than LANGUAGES classes fewer stretches are read at once, in the same memory."""
    block = max(1, min(block, block * LANGUAGES // len(net.bias)))
    data = np.frombuffer(b"".join(texts) + bytes(SPAN), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    full = sizes // SPAN
    total = np.zeros((len(texts), len(net.bias)))

    def add(owner: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None, stop: np.ndarray | None = None) -> None:
        """Stretches at ``starts``; of the positions only those from ``skip`` to ``stop`` count."""
        for i in range(0, len(owner), block):
            at = slice(i, i + block)
            codes = np.ascontiguousarray(data[starts[at, None] + np.arange(SPAN)].T).astype(np.intp)
            weights = real = None
            if skip is not None:
                places = np.arange(SPAN)[:, None]
                real = (places < stop[at]).astype(np.float32)
                weights = real * (places >= skip[at])
            sums = net.probabilities(codes, weights, real)
            for c in range(len(sums)):
                total[:, c] += np.bincount(owner[at], sums[c], len(texts))

    owner = np.repeat(np.arange(len(texts)), full)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    add(owner, begins[owner] + number * SPAN)
    # The rest of a text: the last stretch of it, of which only the bytes not yet read count.
    rest = np.flatnonzero(sizes % SPAN)
    short = sizes[rest] < SPAN
    starts = np.where(short, begins[rest], begins[rest] + sizes[rest] - SPAN)
    add(rest, starts, np.where(short, 0, SPAN - sizes[rest] % SPAN), np.where(short, sizes[rest], SPAN))
    return total / sizes[:, None]


def _predictions(batches: Iterator[pa.RecordBatch], net: Network, letters: str, lang: str, score: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            known = [i for i, ok in enumerate(batch.column(letters).to_pylist()) if ok]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                p = label_documents([texts[i] for i in known], net)
                best = p.argmax(axis=1)
                scores[known] = np.clip(p[np.arange(len(known)), best], 0, 1)
                for i, b in zip(known, best):
                    names[i] = net.languages[b]
            keep = [n for n in batch.schema.names if n != letters]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(names), pa.array(scores)], [*keep, lang, score])


def predicted(docs: DataFrame, net: Network | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``lang`` and ``score``, which it has not; only text is looked at. ``und``
    and 0 where the text is null or has no letter, and everywhere if there is no network."""
    if net is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    letters = free_name(docs, "_letters")
    marked = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType(list(docs.schema.fields)).add(lang, "string").add(score, "double")
    return marked.mapInArrow(given_back(partial(_predictions, net=net, letters=letters, lang=lang, score=score)), schema)


def languages(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score.

    The network reads every byte of every text in stretches of SPAN bytes, labels every position,
    and the mean of the positions' probabilities decides; score is the winner's mean. Texts that
    are null or have no letter are ``und`` with score 0; so is everything if nothing is labelled.
    held_out is false where doc_id is null. Ties go to the language first in the alphabet. Repeated
    rows get a row each; an empty table gives an empty result.
    """
    found = predicted(docs.select("doc_id", "text"), fit(docs, **options))
    held = F.coalesce(_remainder() == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows whose language stays unknown (null or no letter) or whose score is
    below ``least``; without a single labelled row nothing is rejected but those."""
    net = fit(docs, **options)
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    found = predicted(docs, net, lang, score)
    keep = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if net is None else (F.col(lang) != UNKNOWN) & (F.col(score) >= least)
    return found.filter(keep).select([F.col(f"`{c}`") for c in docs.columns])
