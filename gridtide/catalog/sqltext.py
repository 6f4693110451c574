"""Small builders for the repeated parts of window statements."""

from __future__ import annotations


def part(p: str = "point", o: str = "t") -> str:
    return f"(PARTITION BY {p} ORDER BY {o})"


def lag(c: str, n: int = 1, p: str = "point", o: str = "t") -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY {p} ORDER BY {o})"


def lead(c: str, n: int = 1, p: str = "point", o: str = "t") -> str:
    return f"lead({c}, {n}) OVER (PARTITION BY {p} ORDER BY {o})"


def frame(rows: int, shift: int = 0, p: str = "point", o: str = "t") -> str:
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"(PARTITION BY {p} ORDER BY {o} ROWS BETWEEN {rows - 1 + shift} PRECEDING AND {end})"


def roll(f: str, c: str, rows: int, shift: int = 0, need: int | None = None, p: str = "point", o: str = "t") -> str:
    need = rows if need is None else need
    fr = frame(rows, shift, p, o)
    if need <= 1:
        return f"{f}({c}) OVER {fr}"
    return f"CASE WHEN count({c}) OVER {fr} >= {need} THEN {f}({c}) OVER {fr} END"


def columns(cols: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


SQLF = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
