"""One query for each operator over the events table, and the SQL that gives the same rows.

Values are rounded to six places: sums may be taken in another order. Skewness and kurtosis are rounded to three, as
third and fourth powers of deviations lose as many digits again. Missing values are put in by
event_id, the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Panel
from .operators import columns
from .plans import blocked, lisp, signal
from .sources import csvfile, tables, verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PART = "PARTITION BY event_type ORDER BY pos"
SO_FAR = f"({PART} ROWS UNBOUNDED PRECEDING)"
BEFORE = f"({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LN = "CASE WHEN {0} > 0 THEN ln({0}) WHEN {0} = 0 THEN CAST('-inf' AS DOUBLE) END"
EVENTS = """e AS (
  SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
    CASE WHEN event_id % 7 <> 0 THEN value END AS x, CASE WHEN event_id % 5 <> 0 THEN value * 0.5 + 1 END AS y,
    CAST(event_id AS DOUBLE) / 1000 AS z, value - 10 AS u FROM events)"""


def rounded(x: Column) -> Column:
    """Six places, and one zero."""
    return F.round(x, 6) + F.lit(0.0)


def shown(p: Panel, places: dict[str, int] | None = None) -> DataFrame:
    return p.df.select(*p.keys, F.col("__pos").alias("pos"), *[(F.round(F.col(f"`{c}`"), (places or {}).get(c, 6)) + F.lit(0.0)).alias(c) for c in p.values])


def sql_shown(columns_: dict[str, str], source: str = "e", before: str = "", places: dict[str, int] | None = None, where: str = "") -> str:
    cells = ", ".join(f'round({v}, {(places or {}).get(k, 6)}) + 0.0 AS "{k}"' for k, v in columns_.items())
    return f"WITH {EVENTS}{', ' + before if before else ''} SELECT event_type, pos, {cells} FROM {source}{' WHERE ' + where if where else ''}"


def series(name: str, f: Callable[[Panel], Panel], sql: str | dict[str, str], source: str = "e", before: str = "", names: tuple[str, ...] = ("x",), places: dict[str, int] | None = None) -> None:
    """Register f over event values by event type."""
    QUERIES[name] = lambda spark, sf_dir: shown(f(tables.events(spark, sf_dir, names=names)), places)
    SQL[name] = sql_shown({"x": sql} if isinstance(sql, str) else sql, source, before, places)


def with_nan(p: Panel) -> Panel:
    """SQL has NaN where two zeros follow each other in a series of log returns."""
    return replace(p, keeps_nan=True)


def safe(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN ({n}) / ({d}) END"


def no_nan(x: str) -> str:
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


# -- elementwise

series("add", lambda p: p.add(2.5), "x + 2.5")
series("sub", lambda p: p.sub(2.5), "x - 2.5")
series("mul", lambda p: p.mul(-1.5), "x * -1.5")
series("div", lambda p: p.div(4.0), "x / 4.0")
series("div_strict", lambda p: p.div_strict(8.0), "x / 8.0")
series("div_zero", lambda p: p.div(0.0), "CAST(NULL AS DOUBLE)")
for _name, _f, _sql in (
    ("log", lambda p: p.log(), LN.format("u")),
    ("sqrt", lambda p: p.sqrt(), "CASE WHEN u >= 0 THEN sqrt(u) END"),
    ("abs", lambda p: p.abs(), "abs(u)"),
    ("inv", lambda p: p.inv(), safe("1.0", "u")),
    ("inc_dec", lambda p: p.inc().inc().dec(), "u + 1"),
    ("exp", lambda p: p.div(1000.0).exp(), "exp(u / 1000)"),
    ("chop", lambda p: p.chop(0.0, 50.0), "CASE WHEN u IS NOT NULL THEN least(greatest(u, 0.0), 50.0) END"),
):
    series(_name, _f, {"u": _sql}, names=("u",))
for _name, _op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "="), ("ne", "<>")):
    series(f"compare_{_name}", lambda p, n=_name: getattr(p, n)(25.0), f"CAST(x {_op} 25.0 AS DOUBLE)")


def _two(spark: SparkSession, sf_dir: str) -> tuple[Panel, Panel]:
    both = tables.events(spark, sf_dir, names=("x", "y"))
    return both.select("x"), both.select("y")


for _name, _sql in (("add", no_nan("(x + y)")), ("sub", no_nan("(x - y)")), ("mul", no_nan("(x * y)")), ("div", safe("x", "y")), *((f"{n}", f"CAST(x {op} y AS DOUBLE)") for n, op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "="), ("ne", "<>")))):

    def _binary(spark, sf_dir, n=_name):
        a, b = _two(spark, sf_dir)
        return shown(getattr(a, n)(b))

    QUERIES[f"{_name}_frame"], SQL[f"{_name}_frame"] = _binary, sql_shown({"x": _sql})

# -- along a series

PREV = f"last_value(x IGNORE NULLS) OVER {BEFORE}"
series("shift", lambda p: p.shift(3), f"lag(x, 3) OVER ({PART})")
series("diff", lambda p: p.diff(2), f"x - lag(x, 2) OVER ({PART})")
series("dlog", lambda p: with_nan(p).dlog(), f"{LN.format('x')} - {LN.format('p')}", "q", f"q AS (SELECT *, {PREV} AS p FROM e)")
series("dlog_edges", lambda p: p.chop(0.0, 3.0).dlog(), f"CASE WHEN NOT isnan({LN.format('x')} - ({LN.format('p')})) THEN {LN.format('x')} - ({LN.format('p')}) END", "q", f"v AS (SELECT * REPLACE (CASE WHEN x IS NOT NULL THEN least(greatest(x, 0.0), 3.0) END AS x) FROM e), q AS (SELECT *, {PREV} AS p FROM v)")
series("dlog_ofs", lambda p: with_nan(p).dlog_ofs(1), f"{LN.format('x')} - {LN.format('p')}", "q", f"q AS (SELECT *, lag(x, 1) OVER ({PART}) AS p FROM e)")
series("ret", lambda p: p.ret(), safe("x - p", "p"), "q", f"q AS (SELECT *, {PREV} AS p FROM e)")
series("locf", lambda p: p.locf(), f"last_value(x IGNORE NULLS) OVER {SO_FAR}")
series("keep", lambda p: p.keep(4), "CASE WHEN pos % 4 = 0 THEN x END")
series("cs1", lambda p: p.cs1(), f"CASE WHEN x IS NOT NULL THEN 1 + sum(x) OVER {SO_FAR} END")
series("cs1_carry", lambda p: p.cs1_carry(), f"1 + coalesce(sum(x) OVER {SO_FAR}, 0)")
_D = f"q AS (SELECT *, {PREV} AS p FROM e), d AS (SELECT * REPLACE ({LN.format('x')} - {LN.format('p')} AS x) FROM q), f AS (SELECT * REPLACE (CASE WHEN isfinite(x) THEN x / 1000 END AS x) FROM d)"
series("ecs1", lambda p: _finite(p.dlog()).div(1000.0).ecs1(), f"exp(coalesce(sum(x) OVER {SO_FAR}, 0))", "f", _D)
series("ecs1_macro", lambda p: p.add(1.0).ecs1_dlog(), f"CASE WHEN x IS NOT NULL THEN exp(1 + sum(x) OVER {SO_FAR}) END", "d", f"v AS (SELECT * REPLACE (x + 1 AS x) FROM e), q AS (SELECT *, {PREV} AS p FROM v), d AS (SELECT * REPLACE ({LN.format('x')} - {LN.format('p')} AS x) FROM q)")
series("cs1_rows", lambda p: p.o("Z").cs1_carry(), {"x": "1 + coalesce(x, 0)", "y": "1 + coalesce(x, 0) + coalesce(y, 0)", "z": "1 + coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0)"}, names=("x", "y", "z"))
series("ecs1_rows", lambda p: p.div(1000.0).o("Z").ecs1(), {"x": "exp(coalesce(x, 0) / 1000)", "y": "exp((coalesce(x, 0) + coalesce(y, 0)) / 1000)"}, names=("x", "y"))
series("sticky", lambda p: p.sticky(6), "first_value(x IGNORE NULLS) OVER (PARTITION BY event_type, pos // 6 ORDER BY pos ROWS UNBOUNDED PRECEDING)")


def _finite(p: Panel) -> Panel:
    from .functions import exprs as E

    return p.map(E.finite)


# -- rolling, of observations

OBS = f"c AS (SELECT *, count(x) OVER {SO_FAR} AS c FROM e)"


def last(w: int) -> str:
    return f"(PARTITION BY event_type ORDER BY c RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def obs(w: int, source: str = "e", before: str = "") -> str:
    return f"{before}c AS (SELECT *, count(x) OVER {SO_FAR} AS c FROM {source}), s AS (SELECT *, avg(x) OVER {last(w)} AS mu, stddev_samp(x) OVER {last(w)} AS sd FROM c), b AS (SELECT *, lag(CASE WHEN c >= 2 THEN mu END) OVER ({PART}) AS bmu, lag(CASE WHEN c >= 2 THEN sd END) OVER ({PART}) AS bsd, lag(CASE WHEN c >= {w} THEN mu END) OVER ({PART}) AS fmu, lag(CASE WHEN c >= {w} THEN sd END) OVER ({PART}) AS fsd FROM s)"


UR = "100 * sqrt(252)"
for _name, _f, _sql in (
    ("rolling_mean", lambda p: p.rolling_mean(20), "CASE WHEN c >= 20 THEN mu END"),
    ("rolling_std", lambda p: p.rolling_std(20), "CASE WHEN c >= 20 THEN sd END"),
    ("rolling_mean_min2", lambda p: p.rolling_mean_min2(20), "CASE WHEN c >= 2 THEN mu END"),
    ("rolling_std_min2", lambda p: p.rolling_std_min2(20), "CASE WHEN c >= 2 THEN sd END"),
    ("rolling_mean_excl", lambda p: p.rolling_mean_excl(20), "bmu"),
    ("rolling_std_excl", lambda p: p.rolling_std_excl(20), "bsd"),
    ("rolling_zscore", lambda p: p.rolling_zscore(20), safe("x - mu", "CASE WHEN c >= 2 THEN sd END")),
    ("wzs", lambda p: p.wzs(20, 5), safe("x - mu", "CASE WHEN c >= 2 THEN sd END")),
    ("ft_mean", lambda p: p.ft_mean(20), "fmu"),
    ("ft_std", lambda p: p.ft_std(20), "fsd"),
    ("ft_zscore", lambda p: p.ft_zscore(20), safe("x - bmu", "bsd")),
    ("ur", lambda p: p.ur(20, 5), safe("x", f"{UR} * CASE WHEN c >= 2 THEN sd END")),
):
    series(_name, _f, _sql, "b", obs(20))
series("rolling_mean_250", lambda p: p.rolling_mean(250), "CASE WHEN c >= 250 THEN mu END", "b", obs(250))
series("rolling_std_250", lambda p: p.rolling_std(250), "CASE WHEN c >= 250 THEN sd END", "b", obs(250))
series("rolling_std_one", lambda p: p.rolling_std(1), f"CASE WHEN count(x) OVER {SO_FAR} >= 1 THEN CAST(0 AS DOUBLE) END")

# -- rolling, positional


def past(w: int) -> str:
    return f"({PART} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def rows(w: int) -> str:
    return f"({PART} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


_Z = f"s AS (SELECT *, avg(x) OVER {past(20)} AS mu, stddev_samp(x) OVER {past(20)} AS sd, lead(1) OVER ({PART}) AS more FROM e), z AS (SELECT *, CASE WHEN pos >= 20 THEN {safe('x - mu', 'sd')} END AS zs FROM s)"
series("wz0", lambda p: p.wz0(20), "CASE WHEN more IS NOT NULL THEN zs END", "z", _Z)
series("wz0_next", lambda p: p.wz0_next(20), f"lag(zs) OVER ({PART})", "z", _Z)
series("wzs_step", lambda p: p.wzs_step(20, 5), f"last_value(CASE WHEN pos % 5 = 0 AND more IS NOT NULL THEN zs END IGNORE NULLS) OVER {SO_FAR}", "z", _Z)
series(
    "ur_step", lambda p: p.ur_step(20, 5), f"CASE WHEN pos >= 20 THEN x / ({UR} * first_value(CASE WHEN pos >= 20 AND sd > 0 THEN sd END IGNORE NULLS) OVER (PARTITION BY event_type, pos // 5 ORDER BY pos ROWS UNBOUNDED PRECEDING)) END", "s",
    f"s AS (SELECT *, stddev_samp(CASE WHEN x <> 0 THEN x END) OVER {past(20)} AS sd FROM e)",
)
_W = f"s AS (SELECT *, avg(x) OVER {rows(20)} AS mu, stddev_samp(x) OVER {rows(20)} AS sd, count(x) OVER {rows(20)} AS n FROM e)"
series("wmean", lambda p: p.wmean(20), "CASE WHEN pos >= 19 AND n = 20 THEN mu END", "s", _W)
series("wmean0", lambda p: p.wmean0(20), "CASE WHEN pos >= 19 THEN mu END", "s", _W)
series("wstd", lambda p: p.wstd(20), "CASE WHEN pos >= 19 AND n = 20 THEN sd END", "s", _W)
series("wstd0", lambda p: p.wstd0(20), "CASE WHEN pos >= 19 THEN sd END", "s", _W)
series("wv", lambda p: p.wv(20), "CASE WHEN pos >= 19 THEN sd * sqrt(252) END", "s", _W)
series("wq", lambda p: p.wq(20), "CASE WHEN pos >= 19 AND sd <> 0 THEN 1 / (sd * sqrt(252)) END", "s", _W)
_M = f"s AS (SELECT *, avg(x) OVER {past(20)} AS m, stddev_samp(x) OVER {past(20)} AS sd, skewness(x) OVER {past(20)} AS sk, kurtosis_pop(x) OVER {past(20)} AS ku, count(x) OVER {past(20)} AS n FROM e)"
series(
    "ft_wmoments", lambda p: p.ft_wmoments(20, 10),
    {"x_mean": "CASE WHEN n >= 10 THEN m END", "x_std": "CASE WHEN n >= 10 THEN sd END", "x_skew": "CASE WHEN n >= 10 THEN sk * (n - 2) / sqrt(n * (n - 1.0)) END", "x_kurt": "CASE WHEN n >= 10 THEN ku END", "x_count": "CASE WHEN n >= 10 THEN CAST(n AS DOUBLE) END"},
    "s", _M, places={"x_skew": 3, "x_kurt": 3},
)
for _name, _m in (("ft_wmean", "m"), ("ft_wstd", "sd"), ("ft_wskew", "sk * (n - 2) / sqrt(n * (n - 1.0))"), ("ft_wkurt", "ku")):
    _c = "x_" + _name[4:]
    series(_name, lambda p, n=_name: getattr(p, n)(20, 10), {_c: f"CASE WHEN n >= 10 THEN {_m} END"}, "s", _M, places={"x_wskew": 3, "x_wkurt": 3, "x_skew": 3, "x_kurt": 3})
series("zscore", lambda p: p.zscore(), safe("x - mu", "sd"), "s", "s AS (SELECT *, avg(x) OVER (PARTITION BY event_type) AS mu, stddev_samp(x) OVER (PARTITION BY event_type) AS sd FROM e)")

# -- masks and calendar

OFF = "isodow(CAST(ts AS DATE)) >= 6"
series("wkd", lambda p: p.wkd(), f"CASE WHEN NOT ({OFF}) THEN x END")
series("wkd_filter", lambda p: p.wkd_filter(), "x", "f", f"f AS (SELECT * REPLACE (row_number() OVER (PARTITION BY event_type ORDER BY pos) - 1 AS pos) FROM e WHERE NOT ({OFF}))")
_MASKED = f"m AS (SELECT * REPLACE (CASE WHEN NOT m THEN x END AS x), x AS raw FROM (SELECT *, {OFF} AS m FROM e)), "


def _weekdays(p: Panel) -> Panel:
    return p.mask_weekend().with_mask("weekend")


series("masked_rolling_mean", lambda p: _weekdays(p).rolling_mean(20), "CASE WHEN NOT m AND c >= 20 THEN mu END", "b", obs(20, "m", _MASKED))
series("masked_rolling_std", lambda p: _weekdays(p).rolling_std(20), "CASE WHEN NOT m AND c >= 20 THEN sd END", "b", obs(20, "m", _MASKED))
series("masked_ft_zscore", lambda p: _weekdays(p).ft_zscore(20), f"CASE WHEN NOT m THEN {safe('raw - bmu', 'bsd')} END", "b", obs(20, "m", _MASKED))
series("lag_obs", lambda p: _weekdays(p).lag_obs(2), "CASE WHEN NOT m THEN lag(x, 2) OVER (PARTITION BY event_type, m ORDER BY pos) END", "m", f"m AS (SELECT *, {OFF} AS m FROM e)")
series("mask_off", lambda p: _weekdays(p).mask_off().rolling_mean(20), "CASE WHEN c >= 20 THEN mu END", "b", obs(20))
series("mask_algebra", lambda p: _small(p.mask_weekend()).mask_define("rest", ("not", ("or", "weekend", "small"))).with_mask(("and", "rest", ("not", "weekend"))).lag_obs(1), f"CASE WHEN NOT m THEN lag(x, 1) OVER (PARTITION BY event_type, m ORDER BY pos) END", "m", f"m AS (SELECT *, NOT ({OFF} OR coalesce(x < 20, false)) AND NOT ({OFF}) AS m FROM e)")
series("mask_strict", lambda p: _weekdays(p).strict(), f"CASE WHEN NOT ({OFF}) THEN x END")


def _small(p: Panel) -> Panel:
    return p.define("small", F.col("x") < 20)


series("mask_on", lambda p: p.mask_weekend().mask_on("weekend").rolling_mean(20), "CASE WHEN NOT m AND c >= 20 THEN mu END", "b", obs(20, "m", _MASKED))


def _masked_pair(spark: SparkSession, sf_dir: str) -> Panel:
    """The sum of two panels with a mask each: both named masks, and rows that either masks are masked."""
    both = tables.events(spark, sf_dir, names=("x", "y"))
    return _weekdays(both.select("x")).add(both.select("y").define("low", F.col("y") < 20).with_mask("low"))


_LOW = "coalesce(y < 20, false)"
QUERIES["mask_or_frames"] = lambda spark, sf_dir: shown(_masked_pair(spark, sf_dir).strict())
SQL["mask_or_frames"] = sql_shown({"x": f"CASE WHEN NOT ({OFF} OR {_LOW}) THEN x + y END"})
QUERIES["mask_merge"] = lambda spark, sf_dir: _masked_pair(spark, sf_dir).mask_list().withColumn("pct", rounded(F.col("pct")))
SQL["mask_merge"] = f"WITH {EVENTS}, m AS (SELECT 'weekend' AS name, {OFF} AS m FROM e UNION ALL SELECT 'low', {_LOW} FROM e) SELECT name, CAST(sum(m::INT) AS BIGINT) AS masked, count(*) AS total, round(100.0::DOUBLE * sum(m::INT) / count(*), 6) + 0.0 AS pct FROM m GROUP BY name"
QUERIES["mask_list"] = lambda spark, sf_dir: _small(tables.events(spark, sf_dir).mask_weekend()).mask_list().withColumn("pct", rounded(F.col("pct")))
SQL["mask_list"] = f"WITH {EVENTS}, m AS (SELECT 'weekend' AS name, {OFF} AS m FROM e UNION ALL SELECT 'small', coalesce(x < 20, false) FROM e) SELECT name, CAST(sum(m::INT) AS BIGINT) AS masked, count(*) AS total, round(100.0::DOUBLE * sum(m::INT) / count(*), 6) + 0.0 AS pct FROM m GROUP BY name"
QUERIES["mask_stats"] = lambda spark, sf_dir: _small(tables.events(spark, sf_dir).mask_weekend()).mask_stats(("or", "weekend", "small")).withColumn("pct", rounded(F.col("pct")))
SQL["mask_stats"] = f"WITH {EVENTS}, m AS (SELECT {OFF} OR coalesce(x < 20, false) AS m FROM e) SELECT CAST(sum(m::INT) AS BIGINT) AS masked, CAST(count(*) - sum(m::INT) AS BIGINT) AS unmasked, round(100.0::DOUBLE * sum(m::INT) / count(*), 6) + 0.0 AS pct FROM m"

# -- alignment


def _days(spark: SparkSession, sf_dir: str) -> Panel:
    """Days with orders; the index of an aligned panel."""
    days = tables.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice").groupBy("day").agg(F.sum("o_totalprice").alias("total"))
    return Panel.of(days, "day", ["total"])


def _event_days(spark: SparkSession, sf_dir: str) -> Panel:
    """All lines by the Monday of their week, so that most days have none: many rows a day, of which the last one counts."""
    monday = F.date_trunc("week", "l_shipdate").cast("date").alias("day")
    df = tables.table(spark, sf_dir, "lineitem").select(monday, "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("x"))
    return Panel.of(df, "day", ["x"], order=["l_orderkey", "l_linenumber", "x"])


def _shown_days(p: Panel) -> DataFrame:
    return p.df.select(F.col(p.index).cast("string").alias("day"), F.col("__pos").alias("pos"), *[rounded(F.col(f"`{c}`")).alias(c) for c in p.values])


_DAYS = """x AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS day, l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS x FROM lineitem),
l AS (SELECT day, x, true AS hit FROM x QUALIFY row_number() OVER (PARTITION BY day ORDER BY k DESC, n DESC, x DESC NULLS LAST) = 1),
y AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))"""
QUERIES["mapr"] = lambda spark, sf_dir: _shown_days(_event_days(spark, sf_dir).mapr(_days(spark, sf_dir)))
SQL["mapr"] = f"WITH {_DAYS} SELECT CAST(y.day AS VARCHAR) AS day, y.pos, round(l.x, 6) + 0.0 AS x FROM y LEFT JOIN l ON y.day IS NOT DISTINCT FROM l.day"
QUERIES["asofr"] = lambda spark, sf_dir: _shown_days(_event_days(spark, sf_dir).asofr(_days(spark, sf_dir)))
SQL["asofr"] = f"WITH {_DAYS} SELECT CAST(y.day AS VARCHAR) AS day, y.pos, round(l.x, 6) + 0.0 AS x FROM y ASOF LEFT JOIN l ON y.day >= l.day"

QUERIES["mapr_masked"] = lambda spark, sf_dir: _shown_days(_event_days(spark, sf_dir).define("few", F.col("x") < 25).with_mask("few").mapr(_days(spark, sf_dir)).strict())
SQL["mapr_masked"] = f"WITH {_DAYS} SELECT CAST(y.day AS VARCHAR) AS day, y.pos, CASE WHEN NOT coalesce(l.x < 25, false) THEN round(l.x, 6) + 0.0 END AS x FROM y LEFT JOIN l ON y.day IS NOT DISTINCT FROM l.day"
QUERIES["asofr_masked"] = lambda spark, sf_dir: _shown_days(_event_days(spark, sf_dir).asofr(_weekdays(_days(spark, sf_dir))).strict())
SQL["asofr_masked"] = f"WITH {_DAYS} SELECT CAST(y.day AS VARCHAR) AS day, y.pos, CASE WHEN isodow(y.day) < 6 THEN round(l.x, 6) + 0.0 END AS x FROM y ASOF LEFT JOIN l ON y.day >= l.day"


def _asof_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key of its own: values at even events, looked up at odd ones."""
    df = tables.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    a = Panel.of(df.where("event_id % 2 = 0"), "ts", ["value"], ["event_type"], ["event_id"])
    b = Panel.of(df.where("event_id % 2 = 1").withColumnRenamed("value", "own"), "ts", ["own"], ["event_type"], ["event_id"])
    return shown(a.asofr(b))


QUERIES["asofr_keyed"] = _asof_keyed
SQL["asofr_keyed"] = "WITH a AS (SELECT event_type, ts, value FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events WHERE event_id % 2 = 1) SELECT b.event_type, b.pos, round(a.value, 6) + 0.0 AS value FROM b ASOF LEFT JOIN a ON b.event_type = a.event_type AND b.ts >= a.ts"

# -- aggregates

XYZ = ("x", "y", "z")
for _name, _down in (("total", "sum({0})"), ("sum0", "coalesce(sum({0}), 0)"), ("mean", "avg({0})"), ("mean0", "avg(coalesce({0}, 0))"), ("std", "stddev_samp({0})"), ("std0", "stddev_samp({0})"), ("information_ratio", "avg({0}) / stddev_samp({0}) * 16.124515")):
    QUERIES[f"{_name}_down"] = lambda spark, sf_dir, n=_name: (lambda d: d.select("event_type", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in XYZ]))(getattr(tables.events(spark, sf_dir, names=XYZ), n)())
    SQL[f"{_name}_down"] = f"WITH {EVENTS} SELECT event_type, {', '.join(f'round({_down.format(c)}, 4) + 0.0 AS {c}' for c in XYZ)} FROM e GROUP BY event_type"
_SUM, _N = "(coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0))", "((x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT)"
_MU = f"({_SUM} / {_N})"
for _name, _sql in (
    ("total", _SUM), ("mean", _MU), ("mean0", f"{_SUM} / 3"),
    ("std", f"CASE WHEN {_N} > 1 THEN sqrt((coalesce((x - {_MU}) ** 2, 0) + coalesce((y - {_MU}) ** 2, 0) + coalesce((z - {_MU}) ** 2, 0)) / ({_N} - 1)) END"),
):
    QUERIES[f"{_name}_across"] = lambda spark, sf_dir, n=_name: (lambda d: d.select("event_type", "pos", rounded(F.col({"total": "sum"}.get(n, n))).alias("x")))(getattr(tables.events(spark, sf_dir, names=XYZ).o("Z"), n)())
    SQL[f"{_name}_across"] = sql_shown({"x": _sql})
QUERIES["total_grand"] = lambda spark, sf_dir: tables.events(spark, sf_dir, names=XYZ).o("R").total().select((F.round("sum", 3) + F.lit(0.0)).alias("sum"))
SQL["total_grand"] = f"WITH {EVENTS} SELECT round(sum{_SUM}, 3) + 0.0 AS sum FROM e"

# -- columns, pairs, orientation

series("select", lambda p: p.select("z", "x"), {"z": "z", "x": "x"}, names=XYZ)
series("col", lambda p: p.col("y"), {"y": "y"}, names=XYZ)
series("select_num", lambda p: p.select_num(), {"x": "x", "y": "y", "z": "z"}, names=XYZ)
series("column_at", lambda p: p.column_at(1), {"y": "y"}, names=XYZ)
series("setcol", lambda p: p.setcol("x", p.shift(1).select("x")), {"x": f"lag(x) OVER ({PART})", "y": "y"}, names=("x", "y"))
series("withcol", lambda p: p.withcol("x", "locf"), {"x": f"last_value(x IGNORE NULLS) OVER {SO_FAR}", "y": "y"}, names=("x", "y"))
series("map_cols", lambda p: p.map_cols("abs"), {"x": "abs(x)", "u": "abs(u)"}, names=("x", "u"))
QUERIES["apply_cols"] = lambda spark, sf_dir: tables.events(spark, sf_dir, names=XYZ).apply_cols("mean").select(*[rounded(F.col(c)).alias(c) for c in XYZ])
SQL["apply_cols"] = f"WITH {EVENTS} SELECT round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM e"
QUERIES["file_head"] = lambda spark, sf_dir: shown(tables.events(spark, sf_dir).file_head(7))
SQL["file_head"] = sql_shown({"x": "x"}, where="pos < 7")
series("where", lambda p: p.where(F.col("x") > 30), "x", "f", "f AS (SELECT * REPLACE (row_number() OVER (PARTITION BY event_type ORDER BY pos) - 1 AS pos) FROM e WHERE x > 30)")
series("xminus", lambda p: p.xminus(1), {"x\\y": "x - y", "x\\z": "x - z", "y\\z": "y - z"}, names=XYZ)
series("xminus_both", lambda p: p.xminus(0), {"x\\y": "x - y", "y\\x": "y - x"}, names=("x", "y"))
series("xminus_halves", lambda p: p.xminus_halves(), {"x\\z": "x - z", "x\\u": "x - u", "y\\z": "y - z", "y\\u": "y - u"}, names=("x", "y", "z", "u"))
QUERIES["oriented"] = lambda spark, sf_dir: tables.events(spark, sf_dir, names=("x", "y")).o("Z").oriented().withColumn("value", rounded(F.col("value")))
SQL["oriented"] = f"WITH {EVENTS} SELECT event_type, 0 AS line, 'x' AS \"column\", pos, round(x, 6) + 0.0 AS value FROM e UNION ALL SELECT event_type, 1, 'y', pos, round(y, 6) + 0.0 FROM e"
for _name, _turn, _first in (("oriented_s", lambda p: p.o("S"), "xy"), ("oriented_back_z", lambda p: p.o("_Z"), "yx"), ("oriented_back_s", lambda p: p.o("_S"), "yx"), ("ro", lambda p: p.o("N").ro("Z"), "yx")):
    QUERIES[_name] = lambda spark, sf_dir, t=_turn: t(tables.events(spark, sf_dir, names=("x", "y"))).oriented().withColumn("value", rounded(F.col("value")))
    SQL[_name] = f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT event_type, {i} AS line, '{c}' AS \"column\", pos, round({c}, 6) + 0.0 AS value FROM e" for i, c in enumerate(_first))
for _turn in ("H", "N", "_N", "_H"):
    QUERIES[f"oriented{_turn.lower().replace('_', '_back_') if '_' in _turn else '_' + _turn.lower()}"] = lambda spark, sf_dir, t=_turn: (lambda d: d.select("event_type", "pos", *[rounded(F.col(c)).alias(c) for c in ("x", "y")]))(tables.events(spark, sf_dir, names=("x", "y")).o(t).oriented())
    SQL[f"oriented{_turn.lower().replace('_', '_back_') if '_' in _turn else '_' + _turn.lower()}"] = sql_shown({"x": "x", "y": "y"})
QUERIES["long"] = lambda spark, sf_dir: shown(columns.long(tables.events(spark, sf_dir, names=("x", "y"))).locf())
SQL["long"] = f"WITH {EVENTS}, l AS (SELECT event_type, 'x' AS series, pos, x AS v FROM e UNION ALL SELECT event_type, 'y', pos, y FROM e) SELECT event_type, series, pos, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type, series ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS value FROM l"

# -- one long series in blocks

ONE = EVENTS.replace("PARTITION BY event_type ORDER BY ts", "ORDER BY ts")


def _one(spark: SparkSession, sf_dir: str) -> Panel:
    df = tables.table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return blocked.blocked(df, "ts", ["x"], ["ts", "event_id"])


def one(name: str, f: Callable[[Panel], Panel], sql: str, source: str = "e", before: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(f(_one(spark, sf_dir)))
    text = f"WITH {ONE}{', ' + before if before else ''} SELECT pos, round({sql}, 6) + 0.0 AS x FROM {source}"
    SQL[name] = text.replace("PARTITION BY event_type ORDER BY", "ORDER BY")


one("blocked_locf", blocked.locf, f"last_value(x IGNORE NULLS) OVER {SO_FAR}")
one("blocked_dlog", lambda p: blocked.dlog(with_nan(p)), f"{LN.format('x')} - {LN.format('p')}", "q", f"q AS (SELECT *, {PREV} AS p FROM e)")
one("blocked_cs1", blocked.cs1, f"CASE WHEN x IS NOT NULL THEN 1 + sum(x) OVER {SO_FAR} END")
one("blocked_shift", lambda p: blocked.shift(p, 5), f"lag(x, 5) OVER ({PART})")
one("blocked_rolling_mean", lambda p: blocked.rolling_mean(p, 20, 500), "CASE WHEN c >= 20 THEN mu END", "b", obs(20))
one("blocked_rolling_std", lambda p: blocked.rolling_std(p, 20, 500), "CASE WHEN c >= 20 THEN sd END", "b", obs(20))
QUERIES["blocked_asofr"] = lambda spark, sf_dir: _shown_days(blocked.asofr(_event_days(spark, sf_dir), _days(spark, sf_dir)))
SQL["blocked_asofr"] = SQL["asofr"]

# -- delimited text


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Orders as one delimited file in the shared folder: a date, a price with gaps, a key."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"), "o_orderkey")
    path = csvfile.shared_path(spark, "orders-text")
    csvfile.write_csv(Panel.of(orders, "day", ["price", "o_orderkey"], order=["o_orderkey"]), path, single=True)
    return path


_TEXT = "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS pos, round(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, 6) + 0.0 AS price, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders) SELECT CAST(day AS VARCHAR) AS day, pos, {0} FROM o"
QUERIES["read_csv"] = lambda spark, sf_dir: _shown_days(csvfile.read_csv(spark, _written(spark, sf_dir)))
SQL["read_csv"] = _TEXT.format("price, o_orderkey")
QUERIES["load_csv_cols"] = lambda spark, sf_dir: _shown_days(csvfile.load_csv_cols(spark, _written(spark, sf_dir), columns=["price"]))
SQL["load_csv_cols"] = _TEXT.format("price")
QUERIES["csv_head"] = lambda spark, sf_dir: _shown_days(csvfile.read_csv(spark, _written(spark, sf_dir), head=25))
SQL["csv_head"] = _TEXT.format("price, o_orderkey") + " WHERE pos < 25"
QUERIES["csv_verify"] = lambda spark, sf_dir: verify.differences(spark, _written(spark, sf_dir), _written(spark, sf_dir)).groupBy().agg(F.count("*").alias("cells"))
SQL["csv_verify"] = "SELECT CAST(0 AS BIGINT) AS cells"
QUERIES["make_col"] = lambda spark, sf_dir: (lambda p: p.df.select(F.col("__pos").alias("pos"), "value"))(columns.make_col(spark, 1, None, 2.5).locf())
SQL["make_col"] = "SELECT CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 1.0), (1, 1.0), (2, 2.5)) AS v(pos, value)"

# -- the front end and the flagship


def _lisp(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = lisp.Session(spark, x=tables.events(spark, sf_dir))
    return shown(session.run("(defmacro scaled (p k) `(* (locf ,p) ,k)) (let ((w 20)) (-> (scaled x 2.0) (rolling-mean w) (- 1)))"))


QUERIES["lisp"] = _lisp
SQL["lisp"] = sql_shown({"x": "CASE WHEN c >= 20 THEN mu END - 1"}, "b", obs(20, "f", f"f AS (SELECT * REPLACE (2.0 * last_value(x IGNORE NULLS) OVER {SO_FAR} AS x) FROM e), "))


def form(name: str, text: str, sql: str | dict[str, str], source: str = "e", before: str = "", names: tuple[str, ...] = ("x",), panel: Callable[[Panel], Panel] = lambda p: p) -> None:
    """Register a form of the front end over the events, named x."""
    QUERIES[name] = lambda spark, sf_dir: shown(lisp.Session(spark, x=panel(tables.events(spark, sf_dir, names=names))).run(text))
    SQL[name] = sql_shown({"x": sql} if isinstance(sql, str) else sql, source, before)


form("form_arithmetic", "(/ (- (* (+ x 1) 3) 4) 2)", "((x + 1) * 3 - 4) / 2")
form("form_two_panels", "(+ x (shift x 1))", f"x + lag(x) OVER ({PART})")
form("form_same_panel", "(- x x)", "x - x")
form("form_compare", "(>-cols x 25)", "CAST(x > 25 AS DOUBLE)")
form("form_define", "(define half (lambda (p) (/ p 2))) (defparameter k 3) (half (shift x k))", f"lag(x, 3) OVER ({PART}) / 2")
form("form_branches", "(let* ((a 2) (b (+ a 1))) (progn (unless nil (when t (if (> b a) (* x b) x)))))", "x * 3")
form("form_dlog_cols", "(dlog-cols x 2)", f"{LN.format('x')} - {LN.format('p')}", "q", f"q AS (SELECT *, lag(x, 2) OVER ({PART}) AS p FROM e)", panel=with_nan)
form("form_dlog_col", "(dlog-col x)", f"{LN.format('x')} - {LN.format('p')}", "q", f"q AS (SELECT *, {PREV} AS p FROM e)", panel=with_nan)
form("form_cs1_col", "(cs1-col x)", f"CASE WHEN x IS NOT NULL THEN 1 + sum(x) OVER {SO_FAR} END")
form("form_columns", "(withcol (setcol x 'y (abs (col x 'u))) 'x 'locf)", {"x": f"last_value(x IGNORE NULLS) OVER {SO_FAR}", "y": "abs(u)", "u": "u"}, names=("x", "y", "u"))
form("form_masks", "(-> x (mask-weekend) (with-mask 'weekend) (lag-obs 2))", "CASE WHEN NOT m THEN lag(x, 2) OVER (PARTITION BY event_type, m ORDER BY pos) END", "m", f"m AS (SELECT *, {OFF} AS m FROM e)")
form("form_short_names", "(d (ts x 1) 2)", f"lag(x, 1) OVER ({PART}) - lag(x, 3) OVER ({PART})")
form("form_pairs", "(x- x 1)", {"x\\y": "x - y"}, names=("x", "y"))
QUERIES["flagship"] = lambda spark, sf_dir: _shown_days(signal.flagship(spark, sf_dir)).toDF("day", "pos", "total")
SQL["flagship"] = signal.FLAGSHIP_SQL
