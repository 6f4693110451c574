"""Registry of named queries: a DataFrame function and the SQL text of the same result.

Both sides get one final projection: counts and flags as BIGINT, measures
rounded to six places, times and dates as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import base


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    text: tuple[str, ...]
    ints: tuple[str, ...]
    nums: tuple[str, ...]
    times: tuple[str, ...]
    dates: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = self.build(spark, sf_dir)
        cols = [f"CAST(`{c}` AS STRING) AS `{c}`" for c in self.text]
        cols += [f"date_format(`{c}`, 'yyyy-MM-dd HH:mm:ss') AS `{c}`" for c in self.times]
        cols += [f"date_format(`{c}`, 'yyyy-MM-dd') AS `{c}`" for c in self.dates]
        cols += [f"CAST(`{c}` AS BIGINT) AS `{c}`" for c in self.ints]
        cols += [f"round(CAST(`{c}` AS DOUBLE), 6) + 0.0D AS `{c}`" for c in self.nums]
        return df.selectExpr(*cols) if cols else df

    def statement(self) -> str | None:
        if self.sql is None:
            return None
        cols = [f"CAST({c} AS VARCHAR) AS {c}" for c in self.text]
        cols += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in self.times]
        cols += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in self.dates]
        cols += [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints]
        cols += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in self.nums]
        body = self.sql.strip()
        used = base.needed_ctes(body)
        head = "WITH " + ",\n".join(f"{n} AS ({base.CTES[n]})" for n in used) + "\n" if used else ""
        return f"{head}SELECT {', '.join(cols) or '*'} FROM ({body}) AS result"


REGISTRY: dict[str, Query] = {}


def query(key: str, *, sql: str | None = None, text="", ints="", nums="", times="", dates=""):
    def add(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        split = lambda s: tuple(re.split(r"[\s,]+", s.strip())) if s.strip() else ()
        REGISTRY[key] = Query(key, fn, sql, split(text), split(ints), split(nums), split(times), split(dates))
        return fn

    return add


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_statements() -> dict[str, str]:
    return {k: q.statement() for k, q in REGISTRY.items() if q.sql is not None}
