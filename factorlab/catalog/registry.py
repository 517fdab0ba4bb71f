"""Query registration: a name, the result columns, the Spark plan and its SQL twin.

A column is written ``name``, ``name:6`` (round to 6 decimals) or ``name:i``
(bigint). Both sides are projected from this one declaration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.catalog.context import Lab, lab
from factorlab.catalog.sql import oracle


@dataclass(frozen=True)
class Entry:
    name: str
    columns: str
    plan: Callable[[Lab], DataFrame]
    sql: str | None = None

    def _parsed(self) -> list[tuple[str, str | None]]:
        out = []
        for token in self.columns.split():
            name, _, kind = token.partition(":")
            out.append((name, kind or None))
        return out

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(lab(spark, sf_dir))
        cols = []
        for name, kind in self._parsed():
            c = F.col(f"`{name}`")
            if kind == "i":
                c = c.cast("long")
            elif kind:
                # Adding zero turns a rounded -0.0 into 0.0.
                c = F.round(c, int(kind)) + F.lit(0.0)
            cols.append(c.alias(name))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, kind in self._parsed():
            c = f"q.{name}"
            if kind == "i":
                c = f"CAST({c} AS BIGINT)"
            elif kind:
                c = f"round(CAST({c} AS DOUBLE), {kind}) + 0.0::DOUBLE"
            cols.append(f"{c} AS {name}")
        return oracle(f"SELECT {', '.join(cols)} FROM ({self.sql.strip()}) q")


ENTRIES: dict[str, Entry] = {}


def add(name: str, columns: str, plan: Callable[[Lab], DataFrame], sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"duplicate query {name}")
    ENTRIES[name] = Entry(name, columns, plan, sql)
