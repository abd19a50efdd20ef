"""Operator names: what Panel methods, the query registry and the s-expression front end call."""

from __future__ import annotations

from .operators import aggregate, align, columns, cross, lag, masks, orient, rolling, scalar

OPERATORS = {
    # elementwise
    "add": scalar.add, "sub": scalar.sub, "mul": scalar.mul, "div": scalar.div, "div_strict": scalar.div_strict,
    "gt": scalar.gt, "lt": scalar.lt, "ge": scalar.ge, "le": scalar.le, "eq": scalar.eq, "ne": scalar.ne,
    "log": scalar.log, "exp": scalar.exp, "sqrt": scalar.sqrt, "abs": scalar.absolute, "inv": scalar.inv,
    "inc": scalar.inc, "dec": scalar.dec, "chop": scalar.chop, "where": scalar.where,
    # along a series
    "shift": lag.shift, "lag_obs": lag.lag_obs, "diff": lag.diff, "dlog": lag.dlog, "dlog_ofs": lag.dlog_ofs,
    "ret": lag.ret, "locf": lag.locf, "keep": lag.keep, "cs1": lag.cs1, "cs1_carry": lag.cs1_carry,
    "ecs1": lag.ecs1, "ecs1_dlog": lag.ecs1_dlog, "sticky": lag.sticky,
    # rolling
    "rolling_mean": rolling.rolling_mean, "rolling_std": rolling.rolling_std,
    "rolling_mean_min2": rolling.rolling_mean_min2, "rolling_std_min2": rolling.rolling_std_min2,
    "rolling_mean_excl": rolling.rolling_mean_excl, "rolling_std_excl": rolling.rolling_std_excl,
    "rolling_zscore": rolling.rolling_zscore, "wzs": rolling.wzs, "ft_mean": rolling.ft_mean, "ft_std": rolling.ft_std,
    "ft_zscore": rolling.ft_zscore, "ur": rolling.ur, "ur_step": rolling.ur_step, "wz0": rolling.wz0,
    "wz0_next": rolling.wz0_next, "wzs_step": rolling.wzs_step, "wmean": rolling.wmean, "wmean0": rolling.wmean0, "wstd": rolling.wstd, "wstd0": rolling.wstd0,
    "wv": rolling.wv, "wq": rolling.wq, "ft_wmoments": rolling.ft_wmoments, "ft_wmean": rolling.ft_wmean,
    "ft_wstd": rolling.ft_wstd, "ft_wskew": rolling.ft_wskew, "ft_wkurt": rolling.ft_wkurt, "zscore": rolling.zscore,
    # masks and calendar
    "wkd": masks.wkd, "wkd_filter": masks.wkd_filter, "mask_weekend": masks.mask_weekend, "define": masks.define,
    "mask_define": masks.mask_define, "with_mask": masks.with_mask, "mask_on": masks.mask_on, "mask_off": masks.mask_off,
    "mask_stats": masks.mask_stats, "mask_list": masks.mask_list, "strict": masks.strict,
    # alignment
    "mapr": align.mapr, "asofr": align.asofr,
    # aggregates
    "total": aggregate.total, "sum0": aggregate.sum0, "mean": aggregate.mean, "mean0": aggregate.mean0,
    "std": aggregate.std, "std0": aggregate.std0, "information_ratio": aggregate.information_ratio,
    # columns, pairs, orientation
    "xminus": cross.xminus, "xminus_halves": cross.xminus_halves, "o": orient.o, "ro": orient.ro, "oriented": orient.oriented,
    "select": columns.select, "col": columns.col, "column_at": columns.column_at, "select_num": columns.select_num,
    "cols": columns.cols, "length": columns.length, "setcol": columns.setcol, "withcol": columns.withcol,
    "map_cols": columns.map_cols, "apply_cols": columns.apply_cols, "file_head": columns.file_head, "long": columns.long,
}
