"""Sequence operators on one very long series, without putting it in one task.

A series without keys (or with a key that holds a third of all rows) is cut into blocks of positions. Each
block is a window of its own; what a block needs from those before it is one row a block: a count, a sum, the
last value that is there. Those rows, as many as there are blocks, are summed up by one small window and joined
back. Rolling windows are blocked by the running count of observations, and the last w - 1 observations of a block
are copied to the next. Results equal those of the unblocked operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ACTIVE, POS, Panel
from ..functions import exprs as E

BLOCK = "__block"
_before = (Window.unboundedPreceding, -1)
_so_far = (Window.unboundedPreceding, 0)


def numbered(df: DataFrame, mono: str, out: str) -> DataFrame:
    """Replace the monotonically increasing id of a scan by the row's number: counts of the scan's parts are enough.

    The id holds the part in its upper bits and the row in it in the lower 33.
    """
    part, row = F.shiftright(F.col(mono), 33), F.col(mono).bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.select(part.alias("__part")).groupBy("__part").count()
    earlier = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(*_before)), F.lit(0))
    starts = counts.select("__part", earlier.alias("__start"))
    return df.withColumn("__part", part).join(starts, "__part").withColumn(out, (F.col("__start") + row).cast("long")).drop("__part", "__start", mono)


def blocked(df: DataFrame, index: str, values: list[str], order: list[str], blocks: int | None = None) -> Panel:
    """A keyless panel in blocks of about equally many rows; boundaries are quantiles of the first order column."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(order[0])
    number = F.unix_micros(at.cast("timestamp")) if df.schema[order[0]].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else at
    quantiles = [i / n for i in range(1, n)]
    cuts = sorted(set(df.agg(F.percentile_approx(number, quantiles, 10_000)).first()[0] or [])) if n > 1 else []
    rows = df.withColumn(BLOCK, _block(number, cuts))
    starts = carried(rows, {"__start": (F.count(F.lit(1)), F.sum)})
    inner = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order)) - 1
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in values]
    rows = rows.join(starts, BLOCK).withColumn(POS, (F.coalesce("__start", F.lit(0)) + inner).cast("long"))
    return Panel.positioned(rows.select(index, POS, BLOCK, *clean), index, values)


def _block(number: Column, cuts: list) -> Column:
    """How many cuts lie below the number (0 for NULL): a tree of comparisons, as deep as the logarithm of their number."""

    def tree(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(number > F.lit(cuts[mid]), tree(mid + 1, z)).otherwise(tree(a, mid))

    return tree(0, len(cuts)).cast("int")


def carried(rows: DataFrame, what: dict[str, tuple[Column, object]]) -> DataFrame:
    """A row for each block: of each column, the fold over all blocks before it of the block's own aggregate."""
    own = rows.groupBy(BLOCK).agg(*[a.alias(k) for k, (a, _) in what.items()])
    earlier = Window.orderBy(BLOCK).rowsBetween(*_before)
    return own.select(BLOCK, *[fold(F.col(k)).over(earlier).alias(k) for k, (_, fold) in what.items()])


def _last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def _tail(c: str) -> Column:
    """The block's last value that is there."""
    return F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(POS)))


def _with_carries(p: Panel, what) -> DataFrame:
    return p.df.join(carried(p.df, {k: v for c in p.values for k, v in what(c).items()}), BLOCK)


def _inside(frame) -> Window:
    return Window.partitionBy(BLOCK).orderBy(POS).rowsBetween(*frame)


def _done(p: Panel, df: DataFrame, f) -> Panel:
    df = df.withColumns({c: f(c) for c in p.values})
    return p.with_df(df.drop(*[k for k in df.columns if k.startswith("__c_")]))


def locf(p: Panel) -> Panel:
    df = _with_carries(p, lambda c: {f"__c_{c}": (_tail(c), _last)})
    return _done(p, df, lambda c: F.coalesce(_last(F.col(f"`{c}`")).over(_inside(_so_far)), F.col(f"`__c_{c}`")))


def dlog(p: Panel) -> Panel:
    df = _with_carries(p, lambda c: {f"__c_{c}": (_tail(c), _last)})
    prev = lambda c: F.coalesce(_last(F.col(f"`{c}`")).over(_inside(_before)), F.col(f"`__c_{c}`"))
    na = E.same if p.keeps_nan else E.na
    return _done(p, df, lambda c: na(E.ln(F.col(f"`{c}`")) - E.ln(prev(c))))


def cs1(p: Panel) -> Panel:
    df = _with_carries(p, lambda c: {f"__c_{c}": (F.sum(f"`{c}`"), F.sum)})
    total = lambda c: F.coalesce(F.col(f"`__c_{c}`"), F.lit(0.0)) + F.sum(f"`{c}`").over(_inside(_so_far))
    return _done(p, df, lambda c: F.when(F.col(f"`{c}`").isNotNull(), E.na(1 + total(c))))


def shift(p: Panel, k: int) -> Panel:
    """Rows are met by their position, so that no block needs its neighbours."""
    back = p.df.select((F.col(POS) + k).alias(POS), *[F.col(f"`{c}`").alias(f"__c_{c}") for c in p.values])
    return _done(p, p.df.join(back, POS, "left"), lambda c: F.col(f"`__c_{c}`"))


def _rolling(p: Panel, w: int, statistic, least: int, size: int | None) -> Panel:
    if len(p.values) != 1:
        raise ValueError("blocked rolling windows take one column; use Panel.long() for more")
    (c,) = p.values
    x = F.when(~F.col(ACTIVE), F.col(f"`{c}`"))
    size = max(w, size or 100_000)
    df = p.df.withColumn("__x", x).join(carried(p.df.withColumn("__x", x), {"__c_n": (F.count("__x"), F.sum)}), BLOCK)
    df = df.withColumn("__n", F.coalesce("__c_n", F.lit(0)) + F.count("__x").over(_inside(_so_far))).withColumn("__own", F.floor(F.col("__n") / size))
    halo = df.where((F.col("__n") % size > size - w) & F.col("__x").isNotNull()).select(F.col("__own") + 1, "__n", "__x").toDF("__own", "__n", "__x")
    names = [k for k in df.columns if k not in ("__own", "__n", "__x")]
    both = df.withColumn("__real", F.lit(True)).unionByName(halo.withColumn("__real", F.lit(False)), allowMissingColumns=True)
    window = Window.partitionBy("__own").orderBy("__n").rangeBetween(-(w - 1), 0)
    both = both.withColumn("__y", F.when(F.col("__n") >= least, E.na(statistic(F.col("__x")).over(window)))).where("__real")
    return p.with_df(both.select(*[k for k in names if k not in (c, "__c_n")], F.when(~F.col(ACTIVE), F.col("__y")).alias(c)))


def rolling_mean(p: Panel, w: int, size: int | None = None) -> Panel:
    return _rolling(p, w, F.avg, w, size)


def rolling_std(p: Panel, w: int, size: int | None = None) -> Panel:
    return _rolling(p, w, F.stddev_samp, w, size)


def asofr(x: Panel, y: Panel, blocks: int | None = None) -> Panel:
    """Keyless at-or-before alignment: both panels in one order, cut at y's quantiles; a block's last x row is carried."""
    n = blocks or int(y.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.unix_micros(F.col(y.index).cast("timestamp"))
    cuts = sorted(set(y.df.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    block = _block(number, cuts)
    row = F.struct(*[F.col(f"`{c}`") for c in x.values])
    kind = x.df.select(row.alias("r")).schema["r"].dataType
    left = x.df.select(F.col(x.index).alias(y.index), F.lit(0).alias("__side"), POS, row.alias("__row"))
    right = y.df.select(y.index, F.lit(1).alias("__side"), POS, F.lit(None).cast(kind).alias("__row"))
    both = left.unionByName(right).withColumn(BLOCK, block)
    order = F.struct(y.index, "__side", POS)
    carry = carried(both, {"__c_row": (F.max_by("__row", F.when(F.col("__side") == 0, order)), _last)})
    w = Window.partitionBy(BLOCK).orderBy(y.index, "__side", POS).rowsBetween(*_so_far)
    both = both.join(carry, BLOCK).withColumn("__row", F.coalesce(_last(F.col("__row")).over(w), F.col("__c_row"))).where("__side = 1")
    return Panel.positioned(both.select(y.index, POS, *[F.col("__row")[c].alias(c) for c in x.values]), y.index, x.values)
