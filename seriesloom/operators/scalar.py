"""Elementwise arithmetic, mathematics and comparisons: projections only, never a shuffle for literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import ACTIVE, MASK, POS, Panel, together
from ..functions import exprs as E


def binary(p: Panel, other: Panel | float, f) -> Panel:
    """f(left, right) by a literal, or by another panel: columns pair by place, rows by keys and position.

    Panels made of the same rows by operators that keep them are one projection; others are joined.
    The result has the left names, both panels' active masks, and the named masks of both; rows on which masks
    of one name differ raise an error when that mask is read.
    """
    if not isinstance(other, Panel):
        return p.map(lambda x: f(x, F.lit(float(other))))
    if len(p.values) != len(other.values) or p.keys != other.keys:
        raise ValueError("panels differ in keys or number of columns")
    new = [m for m in other.masks if m not in p.masks]
    one = together(p, other)
    if one:
        both, values, active, masks = one
        df = both.df
    else:
        values, active, masks = [f"__t_r{i}" for i in range(len(other.values))], "__t_active", [f"__t_m{i}" for i in range(len(other.masks))]
        named = [MASK + m for m in other.masks]
        right = other.df.select(*p.keys, POS, *[F.col(f"`{c}`").alias(k) for c, k in zip((*other.values, ACTIVE, *named), (*values, active, *masks))])
        df = p.df.join(right, [*p.keys, POS])
    df = df.withColumns({c: f(F.col(f"`{c}`"), F.col(k)) for c, k in zip(p.values, values)}).withColumn(ACTIVE, F.col(ACTIVE) | F.col(active))
    for m, k in zip(other.masks, masks):
        mask = F.col(k)
        if m in p.masks:
            own = F.col(f"`{MASK}{m}`")
            mask = F.when(own == mask, own).otherwise(F.raise_error(F.lit(f"masks {m} of two panels differ")).cast("boolean"))
        df = df.withColumn(MASK + m, mask)
    return p.with_df(df.drop(*values, active, *masks), masks=(*p.masks, *new))


def add(p: Panel, other) -> Panel:
    return binary(p, other, lambda a, b: E.na(a + b))


def sub(p: Panel, other) -> Panel:
    return binary(p, other, lambda a, b: E.na(a - b))


def mul(p: Panel, other) -> Panel:
    return binary(p, other, lambda a, b: E.na(a * b))


def div(p: Panel, other) -> Panel:
    """A zero divisor gives NULL."""
    return binary(p, other, E.divide)


def div_strict(p: Panel, divisor: float) -> Panel:
    """Division by a literal that must not be zero."""
    if float(divisor) == 0:
        raise ZeroDivisionError("division by zero")
    return div(p, divisor)


def _compare(f):
    def op(p: Panel, other) -> Panel:
        return binary(p, other, lambda a, b: E.flag(f(a, b)))

    return op


gt = _compare(lambda a, b: a > b)
lt = _compare(lambda a, b: a < b)
ge = _compare(lambda a, b: a >= b)
le = _compare(lambda a, b: a <= b)
eq = _compare(lambda a, b: a == b)
ne = _compare(lambda a, b: a != b)


def log(p: Panel) -> Panel:
    return p.map(E.ln)


def exp(p: Panel) -> Panel:
    return p.map(F.exp)


def sqrt(p: Panel) -> Panel:
    return p.map(lambda x: F.when(x >= 0, F.sqrt(x)))


def absolute(p: Panel) -> Panel:
    return p.map(F.abs)


def inv(p: Panel) -> Panel:
    return p.map(lambda x: E.divide(F.lit(1.0), x))


def inc(p: Panel) -> Panel:
    return p.map(lambda x: x + 1)


def dec(p: Panel) -> Panel:
    return p.map(lambda x: x - 1)


def chop(p: Panel, lo: float, hi: float) -> Panel:
    if lo > hi:
        raise ValueError("chop needs lo <= hi")
    return p.map(lambda x: E.clip(x, lo, hi))


def where(p: Panel, predicate: Column) -> Panel:
    """Keep rows; positions are renumbered within each series."""
    df = p.df.where(predicate)
    return p.with_df(df.withColumn(POS, (F.row_number().over(p.ordered) - 1).cast("long")))
