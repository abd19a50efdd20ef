"""Alignment of two panels on their index: exact (mapr) and at or before (asofr).

Both give the right panel's rows in their order with the left panel's columns. Of left rows with equal
index the last one counts. Panels with keys align within each key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ACTIVE, HIDDEN, MASK, POS, Panel


def _check(x: Panel, y: Panel) -> None:
    a, b = x.df.schema[x.index].dataType, y.df.schema[y.index].dataType
    if a != b:
        raise TypeError(f"indexes differ in type: {a.simpleString()} and {b.simpleString()}")
    if x.keys != y.keys:
        raise ValueError("panels differ in keys")


def mapr(x: Panel, y: Panel) -> Panel:
    """x at y's index. A NULL index matches a NULL one. Masks are x's; rows x does not have are unmasked.

    The last of equal left rows is a maximum over positions, which combines before the shuffle, so an index
    value that very many left rows share does not gather them.
    """
    _check(x, y)
    own = [ACTIVE, *[MASK + m for m in x.masks]]
    row = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate([*x.values, *own])])
    left = x.df.groupBy(*[F.col(k).alias(f"__l_{k}") for k in x.keys], F.col(x.index).alias("__l_index")).agg(F.max_by(row, POS).alias("__l_row"))
    hidden = [c for c in y.df.columns if c.startswith(HIDDEN)]
    right = y.df.select(*y.keys, F.col(y.index), POS, *hidden)
    on = F.col(y.index).eqNullSafe(F.col("__l_index"))
    for k in x.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__l_{k}"))
    joined = right.join(left, on, "left")
    picked = [F.col(f"__l_row.v{i}").alias(c) for i, c in enumerate(x.values)]
    masks = [F.coalesce(F.col(f"__l_row.v{len(x.values) + i}"), F.lit(False)).alias(c) for i, c in enumerate(own)]
    df = joined.select(*y.keys, F.col(y.index).alias(x.index), POS, *picked, *masks, *hidden)
    return x.with_df(df)


def asofr(x: Panel, y: Panel) -> Panel:
    """x's whole last row at or before each index of y; NULLs where there is none. Masks are y's.

    The two panels are put in one order, x before y where the index is equal, and the last left row is
    carried: one shuffle by key and a sort, never a comparison of all rows with all.
    """
    _check(x, y)
    row = F.struct(*[F.col(f"`{c}`") for c in x.values])
    kind = x.df.select(row.alias("r")).schema["r"].dataType
    masks = [MASK + m for m in y.masks]
    left = x.df.select(*x.keys, F.col(x.index).alias(y.index), F.lit(0).alias("__side"), POS, row.alias("__row"), F.lit(False).alias(ACTIVE), *[F.lit(False).alias(m) for m in masks])
    right = y.df.select(*y.keys, y.index, F.lit(1).alias("__side"), POS, F.lit(None).cast(kind).alias("__row"), ACTIVE, *masks)
    w = Window.partitionBy(*y.keys).orderBy(y.index, "__side", POS).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    df = both.select(*y.keys, y.index, POS, *[F.col("__row")[c].alias(c) for c in x.values], ACTIVE, *masks)
    return y.with_df(df, values=x.values, orientation=x.orientation)
