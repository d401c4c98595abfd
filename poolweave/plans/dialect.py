"""The few SQL spellings in which Spark and DuckDB differ, for the shared view texts."""

from __future__ import annotations

import hashlib


class Spark:
    """Base tables are temporary views, so a table's footer is read once per session."""

    packs = True

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def t(self, name: str) -> str:
        tag = hashlib.md5(self.folder.encode()).hexdigest()[:8]
        view = f"poolweave_{tag}_{name}"
        if not self.spark.catalog.tableExists(view):
            self.spark.read.parquet(f"{self.folder}/{name}.parquet").createOrReplaceTempView(view)
        return view

    def u(self, seed: int, salt: str, *keys: str) -> str:
        parts = ", ".join([f"'{seed}'", f"'{salt}'"] + [f"cast({k} as string)" for k in keys])
        digest = f"substring(md5(cast(concat_ws('|', {parts}) as binary)), 1, 13)"
        return f"((cast(conv({digest}, 16, 10) as bigint) + 0.5D) / 4503599627370496D)"

    def text(self, e: str) -> str:
        return f"cast({e} as string)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def plus_hours(self, ts: str, hours: str) -> str:
        return f"timestamp_micros(unix_micros(cast({ts} as timestamp)) + cast(floor(({hours}) * 3.6e9D) as bigint))"

    def hours(self, a: str, b: str) -> str:
        return f"((unix_micros({a}) - unix_micros({b})) / 3.6e9D)"

    def num(self, x: str) -> str:
        return f"{x}D"

    def mean(self, x: str) -> str:
        """Summed as decimals: equal rows have one mean, in whatever order they come; 12 places are
        more than a double of 1,000 or above holds. Beyond 24 digits before the point it is avg."""
        whole = f"cast(sum(try_cast({x} as decimal(38, 12))) as double) / count({x})"
        return f"case when max(abs({x})) < 1e15D then {whole} else avg({x}) end"

    def labels25(self) -> str:
        return "lateral view explode(sequence(1, 25)) g as n"

    def whole(self, e: str) -> str:
        return f"cast(floor({e}) as bigint)"


class Duck:
    packs = False

    def t(self, name: str) -> str:
        return name

    def u(self, seed: int, salt: str, *keys: str) -> str:
        parts = ", ".join([f"'{seed}'", f"'{salt}'"] + [f"cast({k} as varchar)" for k in keys])
        digest = f"substr(md5(concat_ws('|', {parts})), 1, 13)"
        return f"((('0x' || {digest})::bigint + 0.5::double) / 4503599627370496::double)"

    def text(self, e: str) -> str:
        return f"cast({e} as varchar)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def plus_hours(self, ts: str, hours: str) -> str:
        return f"(cast({ts} as timestamp) + to_microseconds(cast(floor(({hours}) * 3.6e9::double) as bigint)))"

    def hours(self, a: str, b: str) -> str:
        return f"((epoch_us({a}) - epoch_us({b})) / 3.6e9::double)"

    def num(self, x: str) -> str:
        return f"{x}::double"

    def mean(self, x: str) -> str:
        return f"avg({x})"

    def labels25(self) -> str:
        return "cross join (select unnest(range(1, 26)) as n) g"

    def whole(self, e: str) -> str:
        return f"cast(floor({e}) as bigint)"
