"""Differences between the columns of a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Panel
from ..functions import exprs as E


def _pairs(p: Panel, pairs: list[tuple[str, str]]) -> Panel:
    columns = {f"{a}\\{b}": E.na(F.col(f"`{a}`") - F.col(f"`{b}`")) for a, b in pairs}
    return p.with_df(p.df.withColumns(columns).drop(*p.values), values=tuple(columns))


def xminus(p: Panel, h: int = 1) -> Panel:
    """All pairs of columns, named A\\B: each pair once (h = 1) or both ways (h = 0). Masks stay."""
    if len(p.values) < 2 or h not in (0, 1):
        raise ValueError("xminus needs two columns, and h of 0 or 1")
    n = len(p.values)
    return _pairs(p, [(p.values[i], p.values[j]) for i in range(n) for j in range(n) if (j > i if h else j != i)])


def xminus_halves(p: Panel) -> Panel:
    """Every column of the first half less every one of the second."""
    n = len(p.values)
    if not n or n % 2:
        raise ValueError("xminus_halves needs an even number of columns")
    return _pairs(p, [(a, b) for a in p.values[: n // 2] for b in p.values[n // 2 :]])
