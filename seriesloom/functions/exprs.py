"""Column expressions for doubles whose missing value is NULL.

NaN never leaves an expression (it becomes NULL), infinities do. Divisions by zero are NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252
#: Annualisation factors of the risk-scaling and information-ratio operators.
UR_SCALE = 100.0 * TRADING_DAYS**0.5
IR_SCALE = 16.124515


def null() -> Column:
    return F.lit(None).cast("double")


def na(x: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(x, null())


def same(x: Column) -> Column:
    return x


def ln(x: Column) -> Column:
    """Natural logarithm: of 0 minus infinity, of negatives NULL."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def divide(n: Column, d: Column) -> Column:
    """NULL where the divisor is 0."""
    return F.when(d != 0, na(n / d))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def flag(x: Column) -> Column:
    """A predicate as 1.0, 0.0 or NULL."""
    return x.cast("double")


def clip(x: Column, lo: float, hi: float) -> Column:
    # greatest and least skip NULLs, so the guard is needed
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def row_count(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs], F.lit(0))


def row_total(xs: list[Column]) -> Column:
    """Sum of the values that are there; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs], F.lit(0.0))
    return F.when(row_count(xs) > 0, na(total))


def row_mean(xs: list[Column]) -> Column:
    return divide(row_total(xs), row_count(xs))


def row_std(xs: list[Column]) -> Column:
    """Sample deviation of the values that are there, in two passes; NULL for fewer than two."""
    mean, n = row_mean(xs), row_count(xs)
    squares = reduce(lambda a, b: a + b, [F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs], F.lit(0.0))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def row_prefix(xs: list[Column]) -> list[Column]:
    """Running sums from left to right; missing values carry."""
    out, total = [], F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(x, F.lit(0.0))
        out.append(total)
    return out
