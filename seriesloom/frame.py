"""Panel: a DataFrame with an index, a row order, double-valued columns and row masks.

Rows of one series (equal keys) are ordered by POS, which is assigned once from a stable order and
never taken from physical order. Values are doubles; a missing one is NULL. Masks are boolean
columns that operators carry along; ACTIVE says which rows observation-based operators skip.
Every operator returns a new Panel over a lazy DataFrame: Catalyst sees the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "__pos"
ACTIVE = "__active"
MASK = "__mask_"
#: Columns that operators carry along untouched while another panel's steps are taken on the same rows.
HIDDEN = "__h"
#: Operators whose result has other rows than their panel.
NEW_ROWS = ("where", "wkd_filter", "file_head", "asofr", "long")
_serial = count()


@dataclass(frozen=True)
class Step:
    """One operator called on a panel: what it does, and the panel before it."""

    token: object
    act: Callable[[Panel], Panel]
    before: Panel


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    index: str
    values: tuple[str, ...]
    keys: tuple[str, ...] = ()
    masks: tuple[str, ...] = ()
    orientation: str = "H"
    #: Log returns of two zeros (or two infinities) as NaN instead of NULL: for last results only, operators count a NaN as a value.
    keeps_nan: bool = False
    #: The rows this panel was made of, and the operators called on them since: panels of the same rows meet without a join.
    root: object = field(default_factory=object, compare=False, repr=False)
    steps: tuple[Step, ...] = field(default=(), compare=False, repr=False)

    @classmethod
    def of(cls, df: DataFrame, index: str, values: Sequence[str], keys: Sequence[str] = (), order: Sequence[str] = ()) -> Panel:
        """Rows of a series are ordered by the index, then by `order`. NaN values become NULL."""
        by = [F.col(c) for c in (index, *order)]
        pos = (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long")
        clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in values]
        return cls.positioned(df.select(*dict.fromkeys([*keys, index]), *clean, pos.alias(POS)), index, values, keys)

    @classmethod
    def positioned(cls, df: DataFrame, index: str, values: Sequence[str], keys: Sequence[str] = ()) -> Panel:
        """From rows that have their position already."""
        return cls(df.withColumn(ACTIVE, F.lit(False)), index, tuple(values), tuple(keys))

    # -- windows over a series

    @property
    def series(self) -> Window:
        return Window.partitionBy(*self.keys)

    @property
    def ordered(self) -> Window:
        return self.series.orderBy(POS)

    @property
    def so_far(self) -> Window:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self) -> Window:
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    # -- building new panels

    def with_df(self, df: DataFrame, **changes) -> Panel:
        return replace(self, df=df, **{"root": object(), "steps": ()} | changes)

    def map(self, f: Callable[[Column], Column]) -> Panel:
        """A Column function of every value column; windows of all columns share one sort."""
        return self.with_df(self.df.withColumns({c: f(F.col(f"`{c}`")) for c in self.values}))

    def staged(self, first: Callable[[str], dict[str, Column]], *more: Callable[[str], dict[str, Column]]) -> Panel:
        """Stages of helper columns (named by the caller after the column), of which the last sets the values."""
        df = self.df
        for stage in (first, *more):
            columns: dict[str, Column] = {}
            for c in self.values:
                columns |= stage(c)
            df = df.withColumns(columns)
        return self.with_df(df.drop(*[c for c in df.columns if c.startswith("__t_")]))

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def table(self, *extra: str) -> DataFrame:
        """Keys, index, position and values, without the helper columns."""
        return self.df.select(*dict.fromkeys([*self.keys, self.index]), F.col(POS).alias("pos"), *[F.col(f"`{c}`") for c in (*self.values, *extra)])

    def __getattr__(self, name: str):
        """Every operator of the registry is a method: panel.dlog().cs1()."""
        from .registry import OPERATORS

        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)
        def call(*args, **kwargs):
            out = OPERATORS[name](self, *args, **kwargs)
            if not isinstance(out, Panel) or name in NEW_ROWS:
                return out
            if name == "mapr":  # the rows are those of the panel aligned to
                return _traced(out, args[0], lambda y: OPERATORS["mapr"](self, y), object())
            return _traced(out, self, lambda q: OPERATORS[name](q, *args, **kwargs), object())

        return call


def _traced(out: Panel, before: Panel, act: Callable[[Panel], Panel], token: object) -> Panel:
    return replace(out, root=before.root, steps=(*before.steps, Step(token, act, before)))


def _replayed(p: Panel, steps: Sequence[Step]) -> Panel:
    for s in steps:
        p = _traced(s.act(p), p, s.act, s.token)
    return p


def together(p: Panel, other: Panel) -> tuple[Panel, list[str], str, list[str]] | None:
    """Two panels of the same rows in one DataFrame, without a join; None if they are not known to be that.

    Their operators are called again from where the two part, first other's, whose results are then carried along as
    hidden columns, then p's. Gives p with the hidden names of other's values, active mask and named masks.
    """
    if p.root is not other.root:
        return None
    n = 0
    while n < min(len(p.steps), len(other.steps)) and p.steps[n].token is other.steps[n].token:
        n += 1
    start = p.steps[n].before if n < len(p.steps) else p
    h = f"{HIDDEN}{next(_serial)}_"
    fixed = (*start.keys, POS)
    own = [c for c in start.df.columns if c not in fixed and not c.startswith(HIDDEN)]
    on = lambda df: replace(start, df=df)
    q = _replayed(on(start.df.withColumns({f"{h}s{i}": F.col(f"`{c}`") for i, c in enumerate(own)})), other.steps[n:])
    carried = [c for c in q.df.columns if c.startswith(HIDDEN)]
    if any(f"{h}s{i}" not in carried for i in range(len(own))):
        return None
    found = {f"{h}v{i}": c for i, c in enumerate(q.values)} | {f"{h}a": ACTIVE} | {f"{h}m{i}": MASK + m for i, m in enumerate(q.masks)}
    back = [F.col(f"{h}s{i}").alias(c) for i, c in enumerate(own)]
    rest = [F.col(c) for c in carried if not c.startswith(f"{h}s")]
    both = _replayed(on(q.df.select(*fixed, *back, *rest, *[F.col(f"`{c}`").alias(k) for k, c in found.items()])), p.steps[n:])
    if any(k not in both.df.columns for k in found):
        return None
    names = list(found)
    return both, names[: len(q.values)], f"{h}a", names[len(q.values) + 1 :]


def tmp(kind: str, column: str) -> str:
    return f"__t_{kind}_{column}"
