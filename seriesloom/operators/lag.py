"""Lags, differences, returns and fills over a series.

Observation-based operators look back to the last value that is there; positional ones count rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ACTIVE, POS, Panel
from ..functions import exprs as E


def _steps(k: int) -> int:
    if int(k) != k or k < 0:
        raise ValueError("a lag is a whole number of rows, 0 or more")
    return int(k)


def shift(p: Panel, k: int = 1) -> Panel:
    k = _steps(k)
    return p.map(lambda x: F.lag(x, k).over(p.ordered)) if k else p


def lag_obs(p: Panel, k: int = 1) -> Panel:
    """Lag over rows that are not masked, missing values included; masked rows get NULL."""
    k = _steps(k)
    w = p.series.partitionBy(*p.keys, ACTIVE).orderBy(POS)
    return p.map(lambda x: F.when(~F.col(ACTIVE), F.lag(x, k).over(w) if k else x))


def diff(p: Panel, k: int = 1) -> Panel:
    k = _steps(k)
    return p.map(lambda x: E.na(x - F.lag(x, k).over(p.ordered))) if k else p.map(lambda x: E.na(x - x))


def dlog(p: Panel) -> Panel:
    """ln(x) less ln of the last value that is there; zeros give infinities, two zeros NULL, or NaN if the panel keeps it."""
    na = E.same if p.keeps_nan else E.na
    return p.map(lambda x: na(E.ln(x) - E.ln(F.last(x, ignorenulls=True).over(p.before))))


def dlog_ofs(p: Panel, k: int = 1) -> Panel:
    """ln(x) less ln of the value k rows before; NULL unless both are finite; zeros as in dlog()."""
    k = _steps(k)
    na = E.same if p.keeps_nan else E.na
    return p.map(lambda x: na(E.ln(E.finite(x)) - E.ln(E.finite(F.lag(x, k).over(p.ordered)))))


def ret(p: Panel) -> Panel:
    """Simple return on the last value that is there; NULL if that is 0."""

    def f(x):
        prev = F.last(x, ignorenulls=True).over(p.before)
        return E.divide(x - prev, prev)

    return p.map(f)


def locf(p: Panel) -> Panel:
    return p.map(lambda x: F.last(x, ignorenulls=True).over(p.so_far))


def keep(p: Panel, k: int) -> Panel:
    """Values at every k-th position, the others NULL."""
    if int(k) != k or k < 1:
        raise ValueError("keep needs a whole step of 1 or more")
    return p.map(lambda x: F.when(F.col(POS) % int(k) == 0, x))


def cs1(p: Panel) -> Panel:
    """1 plus the running sum; missing values stay missing and the sum goes on."""
    return p.map(lambda x: F.when(x.isNotNull(), E.na(1 + F.sum(x).over(p.so_far))))


def _level(p: Panel, finish) -> Panel:
    if p.orientation in ("Z", "S", "_Z", "_S"):  # across the columns of each row
        sums = E.row_prefix([F.col(f"`{c}`") for c in p.values])
        return p.with_df(p.df.withColumns({c: finish(s) for c, s in zip(p.values, sums)}))
    return p.map(lambda x: finish(F.coalesce(F.sum(x).over(p.so_far), F.lit(0.0))))


def cs1_carry(p: Panel) -> Panel:
    """1 plus the running sum; missing values carry the level."""
    return _level(p, lambda s: 1 + s)


def ecs1(p: Panel) -> Panel:
    """exp of the running sum; missing values carry the level, which starts at 1."""
    return _level(p, F.exp)


def ecs1_dlog(p: Panel) -> Panel:
    """exp(cs1(dlog x)): the compounding macro, a factor e above ecs1 of the log returns."""
    return cs1(dlog(p)).map(F.exp)


def sticky(p: Panel, step: int) -> Panel:
    """The first value that is there in each block of `step` rows, from where it stands to the block's end."""
    block = F.floor(F.col(POS) / F.lit(int(step)))
    df = p.df.withColumn("__t_block", block)
    w = p.series.partitionBy(*p.keys, "__t_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return p.with_df(df.withColumns({c: F.first(F.col(f"`{c}`"), ignorenulls=True).over(w) for c in p.values}).drop("__t_block"))


