"""Rolling statistics.

Observation-based (OBS) windows hold the last w values that are there and not masked, however many rows
they span. With c the running count of such values, that is the RANGE c - w + 1 .. c over c, so the window is
a sorted, native one. Such a frame is summed anew for each row, so wide ones (more than WIDE values) are put together from two
running frames instead: observations are cut into chunks of w, and the last w of them are the head of one chunk and the tail
of the one before. Nothing is subtracted, so no digits cancel, and the cost does not grow with w.
Positional windows are row frames. All deviations are of samples (n - 1).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import ACTIVE, POS, Panel, tmp
from ..functions import exprs as E

#: Widest window that is summed anew for each row.
WIDE = 64


def _width(w: int) -> int:
    if int(w) != w or w < 1:
        raise ValueError("a window is a whole number of rows, 1 or more")
    return int(w)


def _observed(p: Panel, c: str) -> Column:
    return F.when(~F.col(ACTIVE), F.col(f"`{c}`"))


def _count(p: Panel) -> Callable[[str], dict[str, Column]]:
    return lambda c: {tmp("n", c): F.count(_observed(p, c)).over(p.so_far)}


def _last(p: Panel, c: str, w: int):
    return p.series.orderBy(F.col(f"`{tmp('n', c)}`")).rangeBetween(-(w - 1), 0)


def _mean(p: Panel, c: str, w: int, least: int) -> Column:
    return F.when(F.col(f"`{tmp('n', c)}`") >= least, E.na(F.avg(_observed(p, c)).over(_last(p, c, w))))


def _std(p: Panel, c: str, w: int, least: int) -> Column:
    if w == 1 and least == 1:  # one value has no deviation
        return F.when(F.col(f"`{tmp('n', c)}`") >= 1, F.lit(0.0))
    return F.when(F.col(f"`{tmp('n', c)}`") >= least, E.na(F.stddev_samp(_observed(p, c)).over(_last(p, c, w))))


def _shown(x: Column) -> Column:
    """Masked rows show nothing."""
    return F.when(~F.col(ACTIVE), x)


def _frames(p: Panel, w: int, least: int, *kinds: str) -> list[Callable[[str], dict[str, Column]]]:
    """Stages that leave the window's mean or std in helper columns of that name."""
    f = {"mean": _mean, "std": _std}
    return [_count(p), lambda c: {tmp(k, c): f[k](p, c, w, least) for k in kinds}]


def _halves(p: Panel, w: int, least: int, *kinds: str) -> list[Callable[[str], dict[str, Column]]]:
    """The same for wide windows, from the running frames of chunks of w observations."""
    there = lambda c: _observed(p, c).isNotNull()
    at = lambda kind, c: F.col(f"`{tmp(kind, c)}`")
    names = ("sum", "var") if "std" in kinds else ("sum",)
    summed = {"sum": F.sum, "var": F.var_pop}

    def chunk(c: str) -> dict[str, Column]:
        return {tmp("chunk", c): F.when(there(c), F.floor((at("n", c) - 1) / F.lit(w)))}

    def running(c: str) -> dict[str, Column]:
        own = p.series.partitionBy(*p.keys, f"`{tmp('chunk', c)}`")
        frame = (Window.unboundedPreceding, 0)
        heads, tails = own.orderBy(at("n", c)).rowsBetween(*frame), own.orderBy(at("n", c).desc()).rowsBetween(*frame)
        out = {tmp(f"head_{k}", c): F.when(there(c), summed[k](_observed(p, c)).over(heads)) for k in names}
        return out | {tmp(f"tail_{k}", c): F.when(there(c), summed[k](_observed(p, c)).over(tails)) for k in names}

    def older(c: str) -> dict[str, Column]:
        """The tail that begins w - 1 observations before."""
        seen = p.series.partitionBy(*p.keys, there(c)).orderBy(at("n", c))
        return {tmp(f"old_{k}", c): F.lag(at(f"tail_{k}", c), w - 1).over(seen) for k in names}

    def joined(c: str) -> dict[str, Column]:
        heads = (at("n", c) - 1) % F.lit(w) + 1
        tails = F.when(at("chunk", c) > 0, F.lit(w) - heads).otherwise(F.lit(0))
        n = heads + tails
        out = {tmp("w_mean", c): F.when(tails > 0, at("head_sum", c) + at("old_sum", c)).otherwise(at("head_sum", c)) / n}
        if "std" in kinds:
            apart = at("head_sum", c) / heads - at("old_sum", c) / tails
            both = heads * at("head_var", c) + tails * at("old_var", c) + apart * apart * heads * tails / n
            squares = F.when(tails > 0, both).otherwise(heads * at("head_var", c))
            out[tmp("w_std", c)] = F.when(n > 1, F.sqrt(squares / (n - 1)))
        return {k: F.when(there(c), v) for k, v in out.items()}

    def carried(c: str) -> dict[str, Column]:
        """Rows without an observation show the window that ends at the last one."""
        last = lambda x: F.last(x, ignorenulls=True).over(p.so_far)
        # a NaN is a value to last(), so that it is not skipped; it becomes NULL here
        return {tmp(k, c): F.when(at("n", c) >= least, E.na(last(at(f"w_{k}", c)))) for k in kinds}

    return [_count(p), chunk, running, older, joined, carried]


def _stages(p: Panel, w: int, least: int, *kinds: str) -> list[Callable[[str], dict[str, Column]]]:
    return (_halves if w > WIDE else _frames)(p, w, least, *kinds)


def _rolling(p: Panel, w: int, kind: str, least: int) -> Panel:
    return p.staged(*_stages(p, w, least, kind), lambda c: {c: _shown(F.col(f"`{tmp(kind, c)}`"))})


def rolling_mean(p: Panel, w: int) -> Panel:
    """Mean of the last w values; NULL before there are w."""
    return _rolling(p, _width(w), "mean", _width(w))


def rolling_std(p: Panel, w: int) -> Panel:
    return _rolling(p, _width(w), "std", _width(w))


def rolling_mean_min2(p: Panel, w: int) -> Panel:
    """Mean of the last w values or as many as there are, 2 at least; w = 1 never has 2."""
    return _rolling(p, _width(w), "mean", 2) if _width(w) > 1 else p.map(lambda x: E.null())


def rolling_std_min2(p: Panel, w: int) -> Panel:
    return _rolling(p, _width(w), "std", 2) if _width(w) > 1 else p.map(lambda x: E.null())


def _excluding(p: Panel, w: int, finish: Callable[[Column, Column, Column], Column]) -> Panel:
    """finish(x, mean, std) with statistics of the window that ends one physical row before."""
    if _width(w) == 1:
        return p.map(lambda x: E.null())
    back = lambda kind, c: F.lag(F.col(f"`{tmp(kind, c)}`"), 1).over(p.ordered)
    return p.staged(
        *_stages(p, w, 2, "mean", "std"),
        lambda c: {c: _shown(finish(F.col(f"`{c}`"), back("mean", c), back("std", c)))},
    )


def rolling_mean_excl(p: Panel, w: int) -> Panel:
    return _excluding(p, w, lambda x, mean, std: mean)


def rolling_std_excl(p: Panel, w: int) -> Panel:
    return _excluding(p, w, lambda x, mean, std: std)


def ft_zscore(p: Panel, w: int) -> Panel:
    """Score of a row against the two or more values, w at most, up to the row before."""
    return _excluding(p, w, lambda x, mean, std: E.divide(x - mean, std))


def rolling_zscore(p: Panel, w: int, step: int | None = None) -> Panel:
    """Score against a window that holds the row itself; step is accepted and has no effect."""
    if _width(w) == 1:
        return p.map(lambda x: E.null())
    return p.staged(
        *_stages(p, w, 2, "mean", "std"),
        lambda c: {c: _shown(E.divide(F.col(f"`{c}`") - F.col(f"`{tmp('mean', c)}`"), F.col(f"`{tmp('std', c)}`")))},
    )


def wzs(p: Panel, w: int, step: int) -> Panel:
    return rolling_zscore(p, w, step)


def ft_mean(p: Panel, w: int) -> Panel:
    """The strict rolling mean one row later: known before the row."""
    q = rolling_mean(p, w)
    return q.map(lambda x: F.lag(x, 1).over(q.ordered))


def ft_std(p: Panel, w: int) -> Panel:
    q = rolling_std(p, w)
    return q.map(lambda x: F.lag(x, 1).over(q.ordered))


def ur(p: Panel, w: int, step: int | None = None) -> Panel:
    """Value per annualised rolling risk; step is accepted and has no effect."""
    if _width(w) == 1:
        return p.map(lambda x: E.null())
    return p.staged(
        *_stages(p, w, 2, "std"),
        lambda c: {c: _shown(E.divide(F.col(f"`{c}`"), E.UR_SCALE * F.col(f"`{tmp('std', c)}`")))},
    )


# -- positional windows


def ur_step(p: Panel, w: int, step: int = 1) -> Panel:
    """Value per risk of the w rows before it, zeros and missing ones left out; the risk is renewed every `step` rows.

    Between renewals the risk stays; it is renewed as well where none is known yet. Rows before w have none.
    """
    past = p.ordered.rowsBetween(-_width(w), -1)

    def risk(c: str) -> dict[str, Column]:
        x = F.col(f"`{c}`")
        std = F.stddev_samp(F.when(x != 0, x)).over(past)
        return {tmp("risk", c): F.when((F.col(POS) >= w) & (std > 0), E.UR_SCALE * std)}

    held = p.series.partitionBy(*p.keys, "__t_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    df = p.df.withColumns({k: v for c in p.values for k, v in risk(c).items()}).withColumn("__t_block", F.floor(F.col(POS) / F.lit(int(step))))
    df = df.withColumns({c: F.when(F.col(POS) >= w, E.divide(F.col(f"`{c}`"), F.first(F.col(f"`{tmp('risk', c)}`"), ignorenulls=True).over(held))) for c in p.values})
    return p.with_df(df.drop("__t_block", *[tmp("risk", c) for c in p.values]))


def _past_score(p: Panel, w: int) -> Callable[[str], dict[str, Column]]:
    """Score of x against the w rows before it, kept in a helper column; needs two values and w rows."""
    past = p.ordered.rowsBetween(-_width(w), -1)

    def stage(c: str) -> dict[str, Column]:
        x = F.col(f"`{c}`")
        return {tmp("z", c): F.when(F.col(POS) >= w, E.divide(x - F.avg(x).over(past), F.stddev_samp(x).over(past)))}

    return stage


def wz0(p: Panel, w: int) -> Panel:
    """Score against the w rows before, at its own row; the last row of a series has none."""
    ahead = F.lead(F.lit(1), 1).over(p.ordered)
    return p.staged(_past_score(p, w), lambda c: {c: F.when(ahead.isNotNull(), F.col(f"`{tmp('z', c)}`"))})


def wz0_next(p: Panel, w: int) -> Panel:
    """The same score, stored one row later."""
    return p.staged(_past_score(p, w), lambda c: {c: F.lag(F.col(f"`{tmp('z', c)}`"), 1).over(p.ordered)})


def wzs_step(p: Panel, w: int, step: int) -> Panel:
    """The score at every step-th row, carried forward."""
    from .lag import keep, locf

    return locf(keep(wz0(p, w), step))


def _positional(p: Panel, w: int, statistic, strict: bool) -> Panel:
    frame = p.ordered.rowsBetween(-(_width(w) - 1), 0)

    def f(x: Column) -> Column:
        full = (F.col(POS) >= w - 1) & ((F.count(x).over(frame) == w) if strict else F.lit(True))
        return F.when(full, E.na(statistic(x).over(frame)))

    return p.map(f)


def wmean(p: Panel, w: int) -> Panel:
    """Mean of the last w rows; one missing value makes it missing."""
    return _positional(p, w, F.avg, True)


def wmean0(p: Panel, w: int) -> Panel:
    """Mean of the values among the last w rows."""
    return _positional(p, w, F.avg, False)


def wstd(p: Panel, w: int) -> Panel:
    """Deviation of the last w rows; one missing value makes it missing."""
    return _positional(p, w, F.stddev_samp, True)


def wstd0(p: Panel, w: int) -> Panel:
    """Deviation of the values among the last w rows."""
    return _positional(p, w, F.stddev_samp, False)


def wv(p: Panel, w: int) -> Panel:
    """Annualised deviation of the last w rows."""
    return wstd0(p, w).map(lambda x: x * F.lit(float(E.TRADING_DAYS**0.5)))


def wq(p: Panel, w: int) -> Panel:
    """1 over the annualised deviation."""
    return wv(p, w).map(lambda x: E.divide(F.lit(1.0), x))


MOMENTS = {"mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "kurt": F.kurtosis, "count": F.count}


def ft_wmoments(p: Panel, w: int, min_periods: int | None = None, moments: tuple[str, ...] = ("mean", "std", "skew", "kurt", "count")) -> Panel:
    """Moments of the w rows before each row, as columns name_moment; skewness and excess kurtosis are of populations."""
    past, least = p.ordered.rowsBetween(-_width(w), -1), w if min_periods is None else min_periods
    columns, values = {}, []
    for c in p.values:
        x = F.col(f"`{c}`")
        for m in moments:
            value = E.na(MOMENTS[m](x).over(past).cast("double"))
            columns[f"{c}_{m}"] = F.when(F.count(x).over(past) >= least, value)
            values.append(f"{c}_{m}")
    return p.with_df(p.df.withColumns(columns).drop(*p.values), values=tuple(values))


def _one_moment(m: str):
    def op(p: Panel, w: int, min_periods: int | None = None) -> Panel:
        return ft_wmoments(p, w, min_periods, (m,))

    return op


ft_wmean, ft_wstd, ft_wskew, ft_wkurt = (_one_moment(m) for m in ("mean", "std", "skew", "kurt"))


def zscore(p: Panel) -> Panel:
    """Score against the whole series; NULL for fewer than two values or no deviation.

    Two numbers a series, summed up before any shuffle, and met again by key: no series is held by one task.
    """
    columns = [f(F.col(f"`{c}`")).alias(tmp(k, c)) for c in p.values for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    score = lambda c, mean, std: E.divide(F.col(f"`{c}`") - mean, std)
    if not p.keys:
        whole = p.df.agg(*columns)
        one = lambda k, c: whole.select(f"`{tmp(k, c)}`").scalar()
        return p.with_df(p.df.withColumns({c: score(c, one("mean", c), one("std", c)) for c in p.values}))
    own = p.df.groupBy(*[F.col(k).alias(tmp("key", k)) for k in p.keys]).agg(*columns)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"`{tmp('key', k)}`")) for k in p.keys])
    df = p.df.join(own, same, "left").withColumns({c: score(c, F.col(f"`{tmp('mean', c)}`"), F.col(f"`{tmp('std', c)}`")) for c in p.values})
    return p.with_df(df.drop(*own.columns))
