"""Order statistics and higher moments over sliding frames of a series.

A Spark window keeps no order between neighbouring frames: a median or a rank would sort or scan the whole frame again for every row. Here a series is
dealt in blocks of rows with the rows that its frames reach, and each block is one pass: the sorted frame is kept as an indexed skip list, so a row costs
the logarithm of the frame. A block holds a bounded number of rows however long the series is; no row carries a list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import with_halo

#: Own rows of a block; with long frames a block is twice as long as their reach.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Stat:
    """A statistic of the ``rows`` rows that end ``shift`` rows back; NULL below ``need`` values. Missing values take no part.

    ``of`` gets a block's values, this, and with ``group`` a number for each stretch of equal values of that column.
    """

    column: str
    rows: int
    of: Callable[..., np.ndarray]
    shift: int = 0
    need: int = 1
    p: float = 0.5
    kind: str = "double"
    group: str | None = None

    def frame(self, x: np.ndarray):
        return pd.Series(x).shift(self.shift).rolling(self.rows, min_periods=self.need)


def quantile(column: str, rows: int, p: float, shift: int = 0, need: int = 1) -> Stat:
    """Linear quantile."""
    return Stat(column, rows, lambda x, s: s.frame(x).quantile(s.p).to_numpy(), shift, need, p)


def median(column: str, rows: int, shift: int = 0, need: int = 1) -> Stat:
    return Stat(column, rows, lambda x, s: s.frame(x).median().to_numpy(), shift, need)


def count(column: str, rows: int) -> Stat:
    """Values in the frame."""
    return Stat(column, rows, lambda x, s: s.frame(x).count().to_numpy(), kind="bigint")


def below(column: str, rows: int) -> Stat:
    """Values of the frame that are smaller than the row's own."""
    return Stat(column, rows, lambda x, s: s.frame(x).rank(method="min").to_numpy() - 1, kind="bigint")


def up_to(column: str, rows: int) -> Stat:
    """Values of the frame that are not larger than the row's own."""
    return Stat(column, rows, lambda x, s: s.frame(x).rank(method="max").to_numpy(), kind="bigint")


def share_below_before(column: str, rows: int, group: str, longest: int) -> Stat:
    """Share of values smaller than the row's own among the ``rows`` rows before the row's group (of ``longest`` consecutive rows at most)."""
    return Stat(column, rows, _share_below_before, longest, group=group)


def _share_below_before(x: np.ndarray, s: Stat, groups: np.ndarray) -> np.ndarray:
    out = np.full(len(x), np.nan)
    edges = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(x))
    for a, b in zip(edges[:-1], edges[1:]):  # one sort a group
        frame = x[max(0, a - s.rows) : a]
        frame = np.sort(frame[~np.isnan(frame)])
        if len(frame):
            own = x[a:b]
            out[a:b] = np.where(np.isnan(own), 0, np.searchsorted(frame, own)) / len(frame)
    return out


def skew(column: str, rows: int, shift: int = 0, need: int = 1) -> Stat:
    """Bias-corrected skewness; NULL under three values or without spread."""
    return Stat(column, rows, _skew, shift, max(3, need))


def _skew(x: np.ndarray, s: Stat) -> np.ndarray:
    """From running sums of powers of the values less the block's mean, so the level of a series costs no digits."""
    x = pd.Series(x).shift(s.shift).to_numpy()
    known = ~np.isnan(x)
    level = x[known].mean() if known.any() else 0.0
    d = np.where(known, x - level, 0.0)
    frames = []
    for part in (known.astype(float), d, d * d, d * d * d):
        upto = np.concatenate(([0.0], np.cumsum(part)))
        frames.append(upto[1:] - upto[np.maximum(0, np.arange(len(x)) + 1 - s.rows)])
    n, s1, s2, s3 = frames
    with np.errstate(divide="ignore", invalid="ignore"):
        m = s1 / n
        m2 = s2 / n - m * m
        m3 = s3 / n - 3 * m * s2 / n + 2 * m * m * m
        value = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    flat = m2 <= 1e-14 * np.maximum(s2 / np.maximum(n, 1), 1e-300)
    return np.where((n >= s.need) & ~flat, value, np.nan)


def sliding(df: DataFrame, keys: list[str], t: str, stats: dict[str, Stat], rows: int = BLOCK_ROWS) -> DataFrame:
    """df with the statistics as further columns. Rows of a key are ordered by ``t`` (one row a time); keys must not be NULL."""
    before = max(s.rows - 1 + s.shift for s in stats.values())
    blocks, _ = with_halo(df, keys, F.to_date(t), [F.col(t)], before, 0, max(rows, 2 * before))
    kept = [f for f in blocks.schema.fields if f.name not in ("_rn", "_blk", "_own")]
    names = [f.name for f in kept]

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        own = table.column("_own")
        columns = {c: np.array(table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in {s.column for s in stats.values()}}
        out = table.select(names)
        for name, s in stats.items():
            stretch = []
            if s.group:
                g = table.column(s.group).to_pandas()
                stretch = [(g != g.shift()).cumsum().to_numpy()]
            value = pa.array(s.of(columns[s.column], s, *stretch), pa.float64(), from_pandas=True)
            out = out.append_column(name, value.cast(pa.int64()) if s.kind == "bigint" else value)
        return out.filter(own)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {s.kind}" for n, s in stats.items())])
    return blocks.groupBy(*keys, "_blk").applyInArrow(block, schema)
