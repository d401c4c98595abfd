"""Selection methods by name, with the columns each one needs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql.window import WindowSpec

from ..operators import checks, design, disagreement, prototypes, readouts, selection
from ..session import cut_lineage


@dataclass
class Context:
    """Everything a method may use in one round."""

    candidates: DataFrame
    labeled: DataFrame
    budget: int
    seed: int = 0
    round_index: int = 0
    reference: DataFrame | None = None
    fuser: Any = None
    labels: int = 0
    modalities: int = 0
    width: int = 0
    feature_width: int = 0
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Method:
    name: str
    select: Callable[[Context], DataFrame]
    columns: tuple[str, ...] = ()
    needs_fuser: bool = False
    needs_reference: bool = False


def _random(c: Context) -> DataFrame:
    return selection.random_selection(c.candidates, c.budget, c.seed, c.round_index)


def _prototype(c: Context) -> DataFrame:
    return prototypes.acquire(c.candidates, c.labeled, c.budget, c.labels, **c.options)


def _disagreement(c: Context) -> DataFrame:
    fit = {k: c.options[k] for k in ("folds", "epochs", "rate", "prototype") if k in c.options}
    use = {k: v for k, v in c.options.items() if k not in fit}
    state = readouts.train(c.labeled, c.labels, c.modalities, c.width, **fit)
    return disagreement.acquire(c.candidates, state, c.fuser, c.budget, **use).selection


def _design(c: Context) -> DataFrame:
    return design.acquire(
        c.labeled, c.reference, c.candidates, c.fuser, c.labels, c.feature_width, c.modalities, c.budget, c.seed, **c.options
    ).selection


METHODS: dict[str, Method] = {
    m.name: m
    for m in (
        Method("random", _random, ("id",)),
        Method("prototype", _prototype, ("id", "p", "features", "y")),
        Method("disagreement", _disagreement, ("id", "p", "tokens", "y"), needs_fuser=True),
        Method("fused_disagreement", _disagreement, ("id", "p", "tokens", "y"), needs_fuser=True),
        Method("design_synergy", _design, ("id", "p", "features", "tokens", "y"), True, True),
    )
}


def by_id() -> WindowSpec:
    """Id order over a budget-sized selection."""
    return Window.orderBy("id")


def register(method: Method) -> None:
    """Add a method; it takes a Context and returns (id, rank, ...)."""
    METHODS[method.name] = method


def require(name: str, context: Context) -> Method:
    """Refuse a method whose inputs are not there before any work starts."""
    if name not in METHODS:
        raise checks.AuditError(f"unknown method {name!r}; known: {sorted(METHODS)}")
    method = METHODS[name]
    for frame in (context.candidates, context.labeled):
        need = [c for c in method.columns if not (c == "y" and frame is context.candidates)]
        checks.require_columns(frame, need)
    if method.needs_fuser and context.fuser is None:
        raise checks.AuditError(f"method {name!r} needs a fuser")
    if method.needs_reference and context.reference is None:
        raise checks.AuditError(f"method {name!r} needs reference rows")
    return method


def acquire(name: str, context: Context, strict: bool = True) -> DataFrame:
    """Run a method and enforce the selection contract."""
    method = require(name, context)
    picked = method.select(context)
    if strict:
        picked = cut_lineage(picked)
        checks.enforce(
            selection.contract_findings(picked, context.candidates, context.labeled, context.budget)
        )
    return picked
