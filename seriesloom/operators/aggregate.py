"""Column-wise, row-wise and grand aggregates, as the panel's orientation says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import POS, Panel
from ..functions import exprs as E

DOWN = ("H", "N", "_N", "_H")
ACROSS = ("Z", "S", "_Z", "_S")


def _aggregate(p: Panel, down, across, name: str, grand=None) -> DataFrame:
    if p.orientation in DOWN:
        columns = [E.na(down(F.col(f"`{c}`"))).alias(c) for c in p.values]
        return p.df.groupBy(*p.keys).agg(*columns) if p.keys else p.df.agg(*columns)
    if p.orientation in ACROSS:
        return p.df.select(*p.keys, p.index, F.col(POS).alias("pos"), across([F.col(f"`{c}`") for c in p.values]).alias(name))
    if p.orientation == "R" and grand is not None:
        return p.df.agg(grand([F.col(f"`{c}`") for c in p.values]).alias(name))
    raise ValueError(f"{name} has no meaning in orientation {p.orientation}")


def total(p: Panel) -> DataFrame:
    """Sum of the values that are there; NULL if none is."""
    return _aggregate(p, F.sum, E.row_total, "sum", lambda xs: F.sum(E.row_total(xs)))


def sum0(p: Panel) -> DataFrame:
    """Sum; 0 if no value is there."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return _aggregate(p, lambda x: zero(F.sum(x)), lambda xs: zero(E.row_total(xs)), "sum0", lambda xs: zero(F.sum(E.row_total(xs))))


def mean(p: Panel) -> DataFrame:
    return _aggregate(p, F.avg, E.row_mean, "mean")


def mean0(p: Panel) -> DataFrame:
    """Mean with missing values as 0."""

    def filled(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    return _aggregate(p, lambda x: F.avg(filled(x)), lambda xs: E.row_mean([filled(x) for x in xs]), "mean0")


def std(p: Panel) -> DataFrame:
    """Sample deviation; NULL for fewer than two values."""
    return _aggregate(p, F.stddev_samp, E.row_std, "std")


std0 = std


def information_ratio(p: Panel) -> DataFrame:
    """Mean over deviation of each column, annualised."""
    return _aggregate(p, lambda x: E.divide(F.avg(x), F.stddev_samp(x)) * E.IR_SCALE, lambda xs: E.divide(E.row_mean(xs), E.row_std(xs)) * E.IR_SCALE, "ir")
