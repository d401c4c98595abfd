"""Lazy greedy selection under a Fisher design that every pick deflates.

An item has one or more cells (feature vectors with their label probabilities). Its state is a row
that holds the cells and, per cell and label, the alignment a = z'd and the coverage q = z'A^-1 z as
of the last time the table was written. A pick changes both by rank-one terms, and by
Cauchy-Schwarz no more than a few numbers per label say:

    |a'| <= |a| + k sqrt(q),   q >= q' >= r q.

So a task bounds all its items without a look at their vectors, and works out exactly only those
whose bound reaches the best exact value found so far. A pick is one pass over the table that
returns a row from each task; the table is written anew every few picks, without the items picked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import take_top
from ..functions.scalars import with_scalars
from ..functions.vectors import map_slices
from ..session import cut_lineage
from .design import Deflation, FisherDesign

#: Kinds of cells: no, one or all modalities of the item are its own.
EMPTY, SINGLE, FULL = 0, 1, 2
STATE = "id long, own binary, own_p binary, z binary, w binary, a binary, q binary"
#: Items that are worked out at once; slack of a bound for rounding.
AT_ONCE, SLACK = 32, 1e-9


@dataclass(frozen=True)
class Layout:
    """Which cells an item has, in order, and how its score comes from their gains.

    With ``eta`` the score is max(synergy, 0) + eta * additive, where additive sums the mean gains of
    the SINGLE cells over the pool's mean EMPTY gain, and synergy is what FULL has beyond both.
    Without, it is the gain of FULL.
    """

    kinds: tuple[int, ...]
    singles: int = 0
    eta: float | None = None

    def of(self, kind: int) -> np.ndarray:
        return np.flatnonzero(np.array(self.kinds) == kind)

    def parts(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gains [n, cells] -> (sum over modalities of the mean SINGLE gain, FULL gain)."""
        one, full = self.of(SINGLE), self.of(FULL)
        single = gains[:, one].sum(1) * (self.singles / len(one)) if len(one) else np.zeros(len(gains))
        return single, gains[:, full].mean(1)

    def families(self, single, full, single_low=None):
        """Two values of which an item needs the largest to be picked, whatever the EMPTY mean is.

        The score is the larger of eta * single and full - (1 - eta) * single, each with a number
        added that is the same for all items.
        """
        if self.eta is None:
            return np.full_like(full, -np.inf), full
        low = single if single_low is None else single_low
        return self.eta * single, full - (1 - self.eta) * low

    def score(self, single, full, empty):
        if self.eta is None:
            return full
        additive = single - self.singles * empty
        return np.maximum(full - empty - additive, 0.0) + self.eta * additive


@dataclass
class Pending:
    """Rank-one steps since the table was written, for tasks."""

    labels: int
    u: list[np.ndarray] = field(default_factory=list)
    coef: list[np.ndarray] = field(default_factory=list)
    pull: list[np.ndarray] = field(default_factory=list)  # coef * u'g
    k: np.ndarray | float = 0.0
    r: np.ndarray | float = 1.0

    def add(self, z: np.ndarray, u: np.ndarray, coef: np.ndarray, gradient: np.ndarray) -> None:
        star = np.maximum(u @ z, 0.0)
        pull = coef * np.einsum("cd,cd->c", u, gradient)
        self.u, self.coef, self.pull = [*self.u, u], [*self.coef, coef], [*self.pull, pull]
        self.k, self.r = self.k + np.abs(pull) * np.sqrt(star), self.r * (1.0 - coef * star)

    def now(self, z: np.ndarray, a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and q of cells [n, cells] after all steps."""
        for u, coef, pull in zip(self.u, self.coef, self.pull):
            s = z @ u[:, :-1].T + u[:, -1]
            a, q = a - pull * s, q - coef * s**2
        return a, q

    def bounds(self, w: np.ndarray, a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above what gains can be, per cell."""
        size, reach = np.abs(a), self.k * np.sqrt(np.maximum(q, 0.0))
        low = np.maximum(size - reach, 0.0) ** 2 / (w + q)
        return low.sum(-1), ((size + reach) ** 2 / (w + np.maximum(self.r * q, 0.0))).sum(-1)


class _Batch:
    """The arrays of some rows of the state table."""

    def __init__(self, batch: pd.DataFrame, cells: int, width: int) -> None:
        self.n = len(batch)
        self.frame = batch
        self.ids = batch["id"].to_numpy()
        shape = (self.n, cells, -1)
        self.z = np.frombuffer(b"".join(batch["z"])).reshape(self.n, cells, width)
        self.w, self.a, self.q = (np.frombuffer(b"".join(batch[c])).reshape(shape) for c in ("w", "a", "q"))


def state_table(items: DataFrame, cells: DataFrame, design: FisherDesign, layout: Layout) -> DataFrame:
    """``items(id, features, p)`` and ``cells(id, cell, features, p)``, numbered as in the layout ->
    the state under the design. An item's few cells meet in a row; labels are worked off in slices
    of the design, stored in between."""
    packed = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cell", "features", "p"))).alias("c"))
    rows = items.select("id", F.col("features").alias("own"), F.col("p").alias("own_p")).join(packed, "id")
    rows = rows.select("id", "own", "own_p", F.col("c.features").alias("z"), F.col("c.p").alias("p"))
    count, d, empty = len(layout.kinds), design.width + 1, b""

    def raw(arrays) -> list[bytes]:
        return [np.ascontiguousarray(x, np.float64).tobytes() for x in arrays]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = [np.stack(x) for x in b["p"]]
                w = [1.0 / np.maximum(x * (1 - x), 1e-8) for x in p]
                z = [np.stack(x) for x in b["z"]]
                if any(len(x) != count for x in z):
                    raise ValueError("an item has not the cells of the layout")
                yield pd.DataFrame({"id": b["id"], "own": raw(b["own"]), "own_p": raw(b["own_p"]), "z": raw(z), "w": raw(w), "a": empty, "q": empty})

    state = cut_lineage(map_slices(rows, pack, STATE))
    for mine in design.slices():
        block = design.blocks.filter(F.col("label").between(mine.start, mine.stop - 1)).select("label", "inverse", "direction").toPandas().sort_values("label")
        inverse, direction = np.stack(block["inverse"]).reshape(-1, d, d), np.stack(block["direction"])
        held = state.sparkSession.sparkContext.broadcast((inverse, direction))

        def cover(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            inverse, direction = held.value
            for b in batches:
                if len(b):
                    z = np.frombuffer(b"".join(b["z"])).reshape(-1, d - 1)
                    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
                    new = {"a": z @ direction.T, "q": np.stack([((z @ m) * z).sum(1) for m in inverse], axis=1)}
                    out = b.copy()
                    for c, x in new.items():
                        old = np.frombuffer(b"".join(b[c])).reshape(len(z), -1)
                        out[c] = raw(np.concatenate([old, x], axis=1).reshape(len(b), count, -1))
                    yield out

        state = cut_lineage(map_slices(state, cover, STATE))
        held.destroy()
    return state


BEST = "single double, full double, id long, own binary, own_p binary, family int, empty double, empties long, exact long"


def _best(state: DataFrame, layout: Layout, width: int, pending: Pending, taken: list[int]) -> list:
    """From each task its best item of either family, and the sum and number of its EMPTY gains."""
    cells, none, left_out = len(layout.kinds), layout.of(EMPTY), np.array(taken, np.int64)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple | None] = [None, None]
        total, empties, exact = 0.0, 0, 0

        def worked_out(b: _Batch, at: np.ndarray) -> None:
            nonlocal exact
            a, q = pending.now(b.z[at], b.a[at], b.q[at])
            single, full = layout.parts((a**2 / (b.w[at] + q)).sum(-1))
            exact += len(at)
            for f, values in enumerate(layout.families(single, full)):
                for i in np.flatnonzero(values == values.max()):
                    key = (values[i], -int(b.ids[at[i]]))
                    if best[f] is None or key > best[f][0]:
                        row = b.frame.iloc[at[i]]
                        best[f] = (key, single[i], full[i], row["id"], row["own"], row["own_p"])

        for batch in batches:
            if not len(batch):
                continue
            b = _Batch(batch, cells, width)
            if len(none):
                a, q = pending.now(b.z[:, none], b.a[:, none], b.q[:, none])
                total += float((a**2 / (b.w[:, none] + q)).sum())
                empties += b.n * len(none)
            low, high = pending.bounds(b.w, b.a, b.q)
            single_low, _ = layout.parts(low)
            upper = layout.families(*layout.parts(high), single_low)
            open_ = ~np.isin(b.ids, left_out)
            for f in (1, 0) if layout.eta is not None else (1,):
                order = np.flatnonzero(open_)
                order = order[np.argsort(-upper[f][order], kind="stable")]
                for i in range(0, len(order), AT_ONCE):
                    at = order[i : i + AT_ONCE]
                    if best[f] is not None:
                        at = at[upper[f][at] + SLACK * (1 + np.abs(upper[f][at])) >= best[f][0][0]]
                    if not len(at):
                        break
                    worked_out(b, at)
                    open_[at] = False
        rows = [(x[1], x[2], x[3], x[4], x[5], f, 0.0, 0, 0) for f, x in enumerate(best) if x is not None]
        rows.append((0.0, 0.0, None, None, None, -1, total, empties, exact))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BEST.split(", ")]).astype({"id": "Int64"})

    return map_slices(state, kernel, BEST).collect()


def scores(state: DataFrame, layout: Layout, width: int, pending: Pending) -> DataFrame:
    """(id, additive, synergy, total_gain, score) of all rows after the pending steps."""
    cells, none = len(layout.kinds), layout.of(EMPTY)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = _Batch(batch, cells, width)
                a, q = pending.now(b.z, b.a, b.q)
                gains = (a**2 / (b.w + q)).sum(-1)
                single, full = layout.parts(gains)
                yield pd.DataFrame({"id": b.ids, "single": single, "full": full, "empty": gains[:, none].mean(1) if len(none) else 0.0})

    found = cut_lineage(map_slices(state, kernel, "id long, single double, full double, empty double"))
    found = with_scalars(found.drop("empty"), found.agg(F.avg("empty").alias("v0")))
    additive = F.col("single") - F.lit(float(layout.singles)) * F.col("v0")
    out = found.withColumn("additive", additive).withColumn("synergy", F.col("full") - F.col("v0") - F.col("additive"))
    score = F.col("full") if layout.eta is None else F.greatest("synergy", F.lit(0.0)) + F.lit(float(layout.eta)) * F.col("additive")
    return out.select("id", "additive", "synergy", (F.col("full") - F.col("v0")).alias("total_gain"), score.alias("score"))


def _written(state: DataFrame, layout: Layout, width: int, pending: Pending) -> DataFrame:
    """The table with the pending steps in it."""
    cells = len(layout.kinds)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = _Batch(batch, cells, width)
                a, q = pending.now(b.z, b.a, b.q)
                yield batch.assign(a=[x.tobytes() for x in a], q=[x.tobytes() for x in q])

    return cut_lineage(map_slices(state, kernel, STATE))


@dataclass
class Picked:
    """rank, id, score of all picks; how many items were worked out for those of the loop."""

    selection: DataFrame
    exact: list[int]


def pick(state: DataFrame, design: FisherDesign, layout: Layout, budget: int, deflated: int | None = None, fold_every: int = 16) -> Picked:
    """``budget`` items in greedy order: the best score, smallest id first among equal ones, after
    what all earlier picks told the design. After ``deflated`` picks the rest is taken at once, by
    the scores that hold then.

    Items that are picked leave the table by an anti-join when it is written anew (where their EMPTY
    cells count for the pool's mean, they stay, and are passed over); between two writes their ids,
    ``fold_every`` at most, travel with the task.
    """
    spark, width, deflation, pending = state.sparkSession, design.width, Deflation.start(design), Pending(design.labels)
    keep = len(layout.of(EMPTY)) > 0
    steps = budget if deflated is None else min(budget, max(1, deflated))
    chosen: list[tuple[int, int, float]] = []
    worked: list[int] = []
    recent: list[int] = []

    def picks() -> DataFrame:
        return spark.createDataFrame(chosen, "rank long, id long, score double")

    for step in range(steps):
        rows = _best(state, layout, width, pending, [i for _, i, _ in chosen] if keep else recent)
        empties = sum(r["empties"] for r in rows)
        empty = sum(r["empty"] for r in rows) / empties if empties else 0.0
        worked.append(sum(r["exact"] for r in rows))
        found = [(-float(layout.score(r["single"], r["full"], empty)), r["id"], r) for r in rows if r["id"] is not None]
        if not found:
            break
        score, item, row = min(found, key=lambda x: x[:2])
        chosen.append((step + 1, int(item), -score))
        recent.append(int(item))
        if step + 1 == budget:
            break
        own, p = np.frombuffer(row["own"]), np.frombuffer(row["own_p"])
        if step + 1 < steps or deflated is None:
            deflation.add(own, p)
            u, coef = deflation.steps[-1]
            pending.add(np.append(own, 1.0), u, coef, deflation.gradient)
            if len(pending.u) >= fold_every:
                deflation.fold()
                if not keep:
                    state = state.join(picks().select("id"), "id", "left_anti")
                state, pending, recent = _written(state, layout, width, pending), Pending(design.labels), []
    selection = picks()
    if chosen and len(chosen) == steps < budget:
        free = scores(state, layout, width, pending).join(selection.select("id"), "id", "left_anti")
        rest = take_top(free.select("id", "score"), "score", "id", budget - steps)
        selection = selection.unionByName(rest.select((F.col("rank") + F.lit(steps)).cast("long").alias("rank"), "id", "score"))
    return Picked(selection, worked)


def by_gain(rows: DataFrame, design: FisherDesign, budget: int, fold_every: int = 16) -> Picked:
    """``rows(id, features, p)``: the greedy order of their marginal gains, each pick deflating."""
    layout = Layout((FULL,))
    cells = rows.select("id", F.lit(0).alias("cell"), "features", "p")
    return pick(state_table(rows, cells, design, layout), design, layout, budget, None, fold_every)
