"""The flagship: a trading signal from daily revenue by return flag, applied to daily order totals.

Panels here have one row a day, so that their length is bounded by the calendar and not by the data: the large
scans are aggregated by day first, with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Panel
from ..sources.tables import table

FLAGS = ("A", "N", "R")


def revenue(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily revenue, one column for each return flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag", "l_extendedprice", "l_discount")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    daily = lines.groupBy("day").agg(*[F.sum(F.when(F.col("l_returnflag") == f, amount)).alias(f) for f in FLAGS])
    return Panel.of(daily, "day", FLAGS)


def totals(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily order totals."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return Panel.of(orders.groupBy("day").agg(F.sum("o_totalprice").alias("total")), "day", ["total"])


def signal(spark: SparkSession, sf_dir: str) -> Panel:
    """1.0 on days whose spread stood above -1 deviations two rows before, for each pair of flags."""
    return revenue(spark, sf_dir).wkd().dlog().xminus(1).cs1().rolling_zscore(20).gt(-1.0).shift(2)


def flagship(spark: SparkSession, sf_dir: str) -> Panel:
    """Order totals at the signal's days, risk-scaled, times the signal of flags A and N, cumulated."""
    s = signal(spark, sf_dir).select("A\\N")
    risk = totals(spark, sf_dir).mapr(s).dlog().ur(20, 5)
    return risk.mul(s).cs1()


FLAGSHIP_SQL = r"""
WITH r AS (
  SELECT CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) END) AS a,
    sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) END) AS n FROM lineitem GROUP BY 1),
k AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, CASE WHEN isodow(day) < 6 THEN a END AS a, CASE WHEN isodow(day) < 6 THEN n END AS n FROM r),
g AS (SELECT day, pos,
    ln(a) - ln(last_value(a IGNORE NULLS) OVER w) AS a, ln(n) - ln(last_value(n IGNORE NULLS) OVER w) AS n
  FROM k WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT day, pos, CASE WHEN a - n IS NOT NULL THEN 1 + sum(a - n) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS x FROM g),
m AS (SELECT *, count(x) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM c),
z AS (SELECT day, pos, x, CASE WHEN c >= 2 THEN avg(x) OVER w END AS mu, CASE WHEN c >= 2 THEN stddev_samp(x) OVER w END AS sd
  FROM m WINDOW w AS (ORDER BY c RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT day, pos, lag(CAST(CASE WHEN sd <> 0 THEN (x - mu) / sd END > -1.0 AS DOUBLE), 2) OVER (ORDER BY pos) AS s FROM z),
t AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1),
j AS (SELECT s.day, s.pos, s.s, t.total FROM s LEFT JOIN t ON s.day IS NOT DISTINCT FROM t.day),
d AS (SELECT day, pos, s, ln(total) - ln(last_value(total IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS x FROM j),
n AS (SELECT *, count(x) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM d),
u AS (SELECT day, pos, s, x, CASE WHEN c >= 2 THEN stddev_samp(x) OVER (ORDER BY c RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sd FROM n),
v AS (SELECT day, pos, CASE WHEN sd <> 0 THEN x / (100 * sqrt(252) * sd) END * s AS x FROM u)
SELECT CAST(day AS VARCHAR) AS day, pos, round(CASE WHEN x IS NOT NULL THEN 1 + sum(x) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) END, 6) + 0.0 AS total FROM v
"""
