"""Choosing, replacing and describing columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import POS, Panel, together
from ..functions import exprs as E

UNARY = {"log": E.ln, "exp": F.exp, "abs": F.abs}
FOLDS = {"sum": F.sum, "sum0": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg, "mean0": lambda x: F.avg(F.coalesce(x, F.lit(0.0)))}


def select(p: Panel, *names: str) -> Panel:
    missing = [n for n in names if n not in p.values]
    if missing:
        raise KeyError(f"no columns {missing}; there are {list(p.values)}")
    return p.with_df(p.df.drop(*[c for c in p.values if c not in names]), values=tuple(names))


def col(p: Panel, name: str) -> Panel:
    return select(p, name)


def column_at(p: Panel, i: int) -> Panel:
    return select(p, p.values[i])


def select_num(p: Panel) -> Panel:
    return select(p, *[c for c in p.values if p.df.schema[c].dataType.typeName() == "double"])


def cols(p: Panel) -> list[str]:
    return list(p.values)


def length(p: Panel) -> int:
    return p.df.count()


def type_of(v) -> str:
    return "frame" if isinstance(v, Panel) else {"NoneType": "nil", "bool": "bool", "int": "int", "float": "float", "str": "string", "list": "list"}.get(type(v).__name__, type(v).__name__)


def setcol(p: Panel, name: str, new: Column | Panel) -> Panel:
    """Replace or append a column: an expression over the panel, or the only column of a panel with the same rows."""
    values = p.values if name in p.values else (*p.values, name)
    if isinstance(new, Panel):
        if len(new.values) != 1:
            raise ValueError("setcol takes one column")
        one = together(p, new)
        if one:
            both, (value,), active, masks = one
            return p.with_df(both.df.withColumn(name, F.col(value)).drop(value, active, *masks), values=values)
        other = new.df.select(*p.keys, POS, F.col(f"`{new.values[0]}`").alias("__new"))
        return p.with_df(p.df.join(other, [*p.keys, POS], "left").withColumn(name, F.col("__new")).drop("__new"), values=values)
    return p.with_df(p.df.withColumn(name, new), values=values)


def withcol(p: Panel, name: str, operator: str, *args) -> Panel:
    """Apply one operator of the registry to one column, in place."""
    from ..registry import OPERATORS

    done = OPERATORS[operator](select_keep(p, name), *args)
    return done.with_df(done.df, values=p.values)


def select_keep(p: Panel, name: str) -> Panel:
    """A panel that operates on one column and carries the others."""
    if name not in p.values:
        raise KeyError(name)
    return p.with_df(p.df, values=(name,))


def make_col(spark: SparkSession, *values: float, name: str = "value") -> Panel:
    df = spark.createDataFrame([(str(i), None if v is None else float(v), i) for i, v in enumerate(values)], f"ROW string, `{name}` double, {POS} long")
    return Panel.positioned(df, "ROW", [name])


def map_cols(p: Panel, f: str | Callable[[Column], Column]) -> Panel:
    return p.map(UNARY[f] if isinstance(f, str) else f)


def apply_cols(p: Panel, f: str) -> DataFrame:
    """One row: the fold of every column."""
    return p.df.agg(*[E.na(FOLDS[f](F.col(f"`{c}`"))).alias(c) for c in p.values])


def file_head(p: Panel, n: int) -> Panel:
    if n < 0:
        raise ValueError("a head has 0 rows or more")
    return p.with_df(p.df.where(F.col(POS) < n))


def long(p: Panel) -> Panel:
    """One row for each value: the column's name becomes a key, so that series are windows of their own."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").alias("value")) for c in p.values]))
    rest = [c for c in p.df.columns if c not in p.values]
    df = p.df.select(*rest, cells.alias("__cell")).select(*rest, "__cell.series", "__cell.value")
    return p.with_df(df, values=("value",), keys=(*p.keys, "series"))


def concat(a: Panel, b: Panel, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of both, by name."""
    return a.df.select(*(names or a.df.columns)).unionByName(b.df.select(*(names or b.df.columns)))
