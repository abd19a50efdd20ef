"""Row masks and calendar filters.

Named masks are boolean columns; the active mask is one expression over them. Mask expressions are a name, or
("not", e), ("and", e, ...), ("or", e, ...); an empty conjunction or disjunction masks nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ACTIVE, MASK, POS, Panel
from ..functions import exprs as E


def compiled(p: Panel, e) -> Column:
    if isinstance(e, str):
        if e not in p.masks:
            raise KeyError(f"no mask named {e}; there are {', '.join(sorted(p.masks)) or 'none'}")
        return F.col(f"`{MASK}{e}`")
    kind, *parts = e
    inner = [compiled(p, x) for x in parts]
    if kind == "not" and len(inner) == 1:
        return ~inner[0]
    if kind in ("and", "or"):
        return reduce(lambda a, b: a & b if kind == "and" else a | b, inner) if inner else F.lit(False)
    raise ValueError(f"not a mask expression: {e!r}")


def _has_days(p: Panel) -> None:
    if p.df.schema[p.index].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz"):
        raise TypeError("weekends need a date or timestamp index")


def wkd(p: Panel) -> Panel:
    """Values on Saturdays and Sundays become NULL; rows stay, those without a date too."""
    _has_days(p)
    off = F.coalesce(E.weekend(F.col(p.index)), F.lit(False))
    return p.map(lambda x: F.when(~off, x))


def wkd_filter(p: Panel) -> Panel:
    """Drop rows on weekends or without a date; masks are dropped too."""
    from .scalar import where

    _has_days(p)
    q = where(p, ~E.weekend(F.col(p.index)))
    return q.with_df(q.df.drop(*[MASK + m for m in q.masks]).withColumn(ACTIVE, F.lit(False)), masks=())


def define(p: Panel, name: str, predicate: Column) -> Panel:
    """A named mask from any predicate; NULL is not masked."""
    if name in p.masks:
        raise ValueError(f"mask {name} is there already")
    return p.with_df(p.df.withColumn(MASK + name, F.coalesce(predicate, F.lit(False))), masks=(*p.masks, name))


def mask_weekend(p: Panel, name: str = "weekend") -> Panel:
    """Adds the mask; does not activate it. A mask of that name that says the same stays."""
    _has_days(p)
    return p if name == "weekend" and name in p.masks else define(p, name, E.weekend(F.col(p.index)))


def mask_define(p: Panel, name: str, e) -> Panel:
    return define(p, name, compiled(p, e))


def with_mask(p: Panel, e) -> Panel:
    """The expression becomes the active mask, in place of the former."""
    return p.with_df(p.df.withColumn(ACTIVE, compiled(p, e)))


mask_on = with_mask


def mask_off(p: Panel) -> Panel:
    return p.with_df(p.df.withColumn(ACTIVE, F.lit(False)))


def _counts(p: Panel, m: Column) -> list[Column]:
    masked = F.coalesce(F.sum(m.cast("long")), F.lit(0))
    share = E.divide(100.0 * masked, F.count("*"))
    return [masked.alias("masked"), (F.count("*") - masked).alias("unmasked"), share.alias("pct")]


def mask_stats(p: Panel, e) -> DataFrame:
    """masked, unmasked, pct: one row."""
    return p.df.agg(*_counts(p, compiled(p, e)))


def mask_list(p: Panel) -> DataFrame:
    """name, masked, total, pct of each named mask, by name, in one pass over the rows."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(f"`{MASK}{m}`").alias("on")) for m in sorted(p.masks)])) if p.masks else None
    if named is None:
        return p.df.sparkSession.createDataFrame([], "name string, masked long, total long, pct double")
    rows = p.df.select(named.alias("m")).select("m.name", "m.on")
    masked = F.sum(F.col("on").cast("long"))
    return rows.groupBy("name").agg(masked.alias("masked"), F.count("*").alias("total"), (100.0 * masked / F.count("*")).alias("pct")).orderBy("name")


def strict(p: Panel) -> Panel:
    """Blank the values of masked rows: the written contract, which elementwise operators do not apply themselves."""
    return p.map(lambda x: F.when(~F.col(ACTIVE), x))


def masked_rows(p: Panel) -> DataFrame:
    return p.df.where(F.col(ACTIVE)).select(*p.keys, p.index, POS)
