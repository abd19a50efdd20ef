"""Orientations: the eight symmetries of a table, and the modes X (none) and R (grand total).

Only how later operators read the table changes; rows and columns move when it is read out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import POS, Panel

#: Each symmetry as (transposed, rows reversed, columns reversed).
SYMMETRIES = {
    "H": (False, False, False), "N": (False, True, False), "_N": (False, False, True), "_H": (False, True, True),
    "Z": (True, False, False), "S": (True, True, False), "_Z": (True, True, True), "_S": (True, False, True),
}
MODES = ("X", "R")
_BACK = {v: k for k, v in SYMMETRIES.items()}


def o(p: Panel, orientation: str) -> Panel:
    if orientation not in SYMMETRIES and orientation not in MODES:
        raise ValueError(f"no orientation {orientation}")
    return p.with_df(p.df, orientation=orientation)


def composed(a: str, b: str) -> str:
    """The symmetry that does a, then b."""
    ta, ra, ca = SYMMETRIES[a]
    tb, rb, cb = SYMMETRIES[b]
    # a transposition turns reversed rows into reversed columns
    r, c = (ca, ra) if tb else (ra, ca)
    return _BACK[(ta != tb, r != rb, c != cb)]


def ro(p: Panel, orientation: str) -> Panel:
    """Turn further, relative to the present orientation."""
    if p.orientation in MODES or orientation in MODES:
        raise ValueError("modes X and R do not compose")
    return o(p, composed(p.orientation, orientation))


def oriented(p: Panel) -> DataFrame:
    """Rows and columns in the order the orientation shows them; transposed ones as (column, pos, value) rows."""
    turned, rows, columns = SYMMETRIES.get(p.orientation, (False, False, False))
    names = list(reversed(p.values)) if columns else list(p.values)
    order = F.col("pos").desc() if rows else F.col("pos").asc()
    df = p.table()
    if not turned:
        return df.select(*p.keys, p.index, "pos", *[f"`{c}`" for c in names]).orderBy(*p.keys, order)
    long = df.select(*p.keys, "pos", F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names])).alias("line", "cell"))
    return long.select(*p.keys, "line", "cell.column", "pos", "cell.value").orderBy(*p.keys, "line", order)
