"""Write COVERAGE.md: every inventory id with the registered queries that exercise it."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

from . import registry


def table() -> str:
    by_id: dict[str, list[str]] = defaultdict(list)
    for name, q in registry.load().items():
        for c in q.covers:
            by_id[c].append(f"`{name}`" + ("" if q.sql else " (rows)"))
    order = sorted(by_id, key=lambda c: (c[0], int(re.sub(r"\D", "", c))))
    lines = ["# Coverage", "", "`(rows)` marks a query without SQL.", "", "| id | queries |", "|---|---|"]
    return "\n".join(lines + [f"| {c} | {', '.join(by_id[c])} |" for c in order]) + "\n"


if __name__ == "__main__":
    Path(__file__).resolve().parents[2].joinpath("COVERAGE.md").write_text(table())
