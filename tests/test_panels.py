"""Literal cases: edges of missing values, zeros, order, duplicates and masks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesloom.frame import Panel
from seriesloom.operators.columns import make_col
from seriesloom.plans import lisp

NAN = float("nan")
INF = float("inf")


def column(spark, *values):
    return make_col(spark, *values)


def values(p, name=None):
    name = name or p.values[0]
    return [r[name] for r in p.df.orderBy("__pos").collect()]


def close(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and (x == y or math.isclose(x, y, abs_tol=1e-9))) for x, y in zip(a, b))


@pytest.mark.parametrize(
    ("op", "args", "given", "expected"),
    [
        ("dlog", (), (100, None, None, 110), (None, None, None, math.log(1.1))),
        ("dlog_ofs", (), (100, None, None, 110), (None, None, None, None)),
        ("dlog", (), (1, 0), (None, -INF)),
        ("dlog", (), (0, 1), (None, INF)),
        ("dlog", (), (0, 0), (None, None)),
        ("dlog", (), (-1, 1, 2), (None, None, math.log(2))),
        ("locf", (), (1, None, None, 2, None), (1, 1, 1, 2, 2)),
        ("locf", (), (None, 1), (None, 1)),
        ("keep", (3,), (10, 11, 12, 13, 14, 15), (10, None, None, 13, None, None)),
        ("cs1", (), (0.01, None, 0.03), (1.01, None, 1.04)),
        ("cs1_carry", (), (0.01, None, 0.03), (1.01, 1.01, 1.04)),
        ("ecs1", (), (None, 1.0), (1.0, math.e)),
        ("gt", (2,), (1, None, 3), (0, None, 1)),
        ("inv", (), (0, 2, None), (None, 0.5, None)),
        ("sqrt", (), (-1, 4), (None, 2)),
        ("log", (), (0, -1, 1), (-INF, None, 0)),
        ("div", (0,), (1, 2), (None, None)),
        ("chop", (0, 1), (-5, None, 5), (0, None, 1)),
        ("ret", (), (0, 5, 10), (None, None, 1)),
        ("shift", (0,), (1, 2), (1, 2)),
        ("rolling_mean", (2,), (1, None, 3, None), (None, None, 2, 2)),
        ("rolling_mean_min2", (3,), (1, 2, None, 4), (None, 1.5, 1.5, 7 / 3)),
        ("rolling_std", (1,), (5, 6), (0, 0)),
        ("rolling_mean_min2", (1,), (5, 6), (None, None)),
        ("ft_wmean", (3,), (1, 2, 3, 4, 5, 6), (None, None, None, 2, 3, 4)),
        ("ft_wmean", (3, 2), (1, None, 3, 4, None, 6), (None, None, None, 2, 3.5, 3.5)),
        ("ft_wstd", (3,), (1, 2, 3, 4, 5), (None, None, None, 1, 1)),
        ("zscore", (), (3, 3, 3), (None, None, None)),
        ("zscore", (), (1,), (None,)),
        ("sub", (1,), (INF, None), (INF, None)),
    ],
)
def test_literals(spark, op, args, given, expected):
    p = getattr(column(spark, *given), op)(*args)
    assert close(values(p), list(expected))


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(1, NAN), (2, 1.0)], "t int, x double")
    assert values(Panel.of(df, "t", ["x"])) == [None, 1.0]


def test_empty_panels(spark):
    df = spark.createDataFrame([], "t int, x double")
    p = Panel.of(df, "t", ["x"])
    assert values(p.dlog().cs1().rolling_zscore(5)) == []
    assert p.total().collect()[0]["x"] is None
    assert values(p.mapr(p)) == [] and values(p.asofr(p)) == []


def test_arguments_are_checked(spark):
    p = column(spark, 1, 2)
    for bad in (lambda: p.shift(-1), lambda: p.chop(2, 1), lambda: p.rolling_mean(0), lambda: p.keep(0), lambda: p.xminus(1), lambda: p.select("no"), lambda: p.o("Q"), lambda: p.with_mask("no"), lambda: p.wkd()):
        with pytest.raises((ValueError, KeyError, TypeError)):
            bad()
    with pytest.raises(ZeroDivisionError):
        p.div_strict(0)


def test_mapr_last_wins_and_null_keys_match(spark):
    x = Panel.of(spark.createDataFrame([("A", 100.0, 0), ("A", 200.0, 1), ("B", 300.0, 2), (None, 7.0, 3)], "k string, v double, i int"), "k", ["v"], order=["i"])
    y = Panel.of(spark.createDataFrame([("A", 0.0), ("B", 0.0), ("C", 0.0), (None, 0.0)], "k string, w double"), "k", ["w"])
    assert sorted(((r.k, r.v) for r in x.mapr(y).df.collect()), key=str) == sorted([("A", 200.0), ("B", 300.0), ("C", None), (None, 7.0)], key=str)


def test_asofr(spark):
    day = lambda n: dt.date(1970, 1, 1) + dt.timedelta(n)
    x = Panel.of(spark.createDataFrame([(day(18000), 100.0, 0), (day(18001), 101.0, 1), (day(18003), 103.0, 2), (day(18003), 103.5, 3), (day(18005), 105.0, 4)], "d date, v double, i int"), "d", ["v"], order=["i"])
    y = Panel.of(spark.createDataFrame([(day(n), 0.0) for n in (17999, 18000, 18002, 18003, 18004)], "d date, w double"), "d", ["w"])
    assert values(x.asofr(y)) == [None, 100, 101, 103.5, 103.5]
    assert values(x.asofr(x)) == [100, 101, 103.5, 103.5, 105] or len(values(x.asofr(x))) == 5


def test_asofr_takes_whole_rows(spark):
    x = Panel.of(spark.createDataFrame([(1, 5.0), (2, None)], "t int, v double"), "t", ["v"])
    y = Panel.of(spark.createDataFrame([(1, 0.0), (3, 0.0)], "t int, w double"), "t", ["w"])
    assert values(x.asofr(y)) == [5.0, None]


def test_join_of_unlike_indexes_is_refused(spark):
    x = Panel.of(spark.createDataFrame([(1, 5.0)], "t int, v double"), "t", ["v"])
    y = Panel.of(spark.createDataFrame([("1", 5.0)], "t string, v double"), "t", ["v"])
    with pytest.raises(TypeError):
        x.mapr(y)


def week(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), float(i)) for i in range(9)]  # from a Monday on
    return Panel.of(spark.createDataFrame(rows, "d date, v double"), "d", ["v"])


def test_weekends(spark):
    p = week(spark)
    assert values(p.wkd()) == [0, 1, 2, 3, 4, None, None, 7, 8]
    assert values(p.wkd_filter()) == [0, 1, 2, 3, 4, 7, 8]
    m = p.mask_weekend().with_mask("weekend")
    assert values(m.lag_obs(1)) == [None, 0, 1, 2, 3, None, None, 4, 7]
    assert values(m.rolling_mean(2)) == [None, 0.5, 1.5, 2.5, 3.5, None, None, 5.5, 7.5]
    assert values(m.abs()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]  # elementwise operators ignore masks
    assert [tuple(r) for r in m.mask_list().collect()] == [("weekend", 2, 9, pytest.approx(200 / 9))]
    assert m.with_mask(("and",)).mask_stats(("not", "weekend")).first()["masked"] == 7


def test_orientations_compose_to_a_group():
    from seriesloom.operators.orient import SYMMETRIES, composed

    assert composed("Z", "Z") == "H"
    for a in SYMMETRIES:
        assert composed("H", a) == a == composed(a, "H")
        assert sorted(composed(a, b) for b in SYMMETRIES) == sorted(SYMMETRIES)
        for b in SYMMETRIES:
            for c in SYMMETRIES:
                assert composed(composed(a, b), c) == composed(a, composed(b, c))


def test_aggregates_follow_orientation(spark):
    p = Panel.of(spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)], "t int, A double, B double"), "t", ["A", "B"])
    assert tuple(p.total().first()) == (9, 12)
    assert [r["sum"] for r in p.o("Z").total().orderBy("pos").collect()] == [3, 7, 11]
    assert p.o("R").total().first()["sum"] == 21
    with pytest.raises(ValueError):
        p.o("X").total()


def test_laws(spark):
    p = column(spark, 3, None, 7, 2, None, 11, 5, 6)
    assert close(values(p.add(0)), values(p)) and close(values(p.mul(1)), values(p))
    assert close(values(p.shift(1).shift(2)), values(p.shift(3)))
    assert close(values(p.mul(3).rolling_std(3)), values(p.rolling_std(3).mul(3)))
    assert close(values(p.add(9).rolling_std(3)), values(p.rolling_std(3)))
    assert close(values(p.mul(4).add(1).rolling_zscore(3)), values(p.rolling_zscore(3)))
    assert close(values(p.locf().locf()), values(p.locf()))


def test_rows_not_named_by_order(spark):
    df = spark.createDataFrame([(2, 20.0), (1, 10.0), (3, 30.0)], "t int, x double").repartition(3)
    assert values(Panel.of(df, "t", ["x"]).shift(1)) == [None, 10, 20]


def test_named_masks_of_two_panels(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(6)], "t long, x double")
    p = Panel.of(rows, "t", ["x"])
    a, b = p.define("low", F.col("x") < 2), p.define("high", F.col("x") > 3)
    both = a.add(b)
    assert both.masks == ("low", "high")
    assert {(r["name"], r["masked"]) for r in both.mask_list().collect()} == {("low", 2), ("high", 2)}
    assert [r["x"] for r in both.df.orderBy("__pos").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert a.add(a).mask_list().collect()[0]["masked"] == 2
    with pytest.raises(Exception, match="masks low of two panels differ"):
        a.add(p.define("low", F.col("x") < 3)).mask_list().collect()


def test_the_panel_stands_first_in_forms(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(3)], "t long, x double")
    s = lisp.Session(spark, x=Panel.of(rows, "t", ["x"]))
    value = lambda form: [r["x"] for r in s.run(form).df.orderBy("__pos").collect()]
    assert value("(- x x)") == [0.0, 0.0, 0.0] and value("(- x 10)") == [-10.0, -9.0, -8.0] and value("(cs1-col x)") == [1.0, 2.0, 4.0]
    for form in ("(- 10 x)", "(/ 1 x)", "(> 0 x)"):
        with pytest.raises(TypeError):
            s.run(form)


def test_wide_windows_equal_narrow_ones(spark, monkeypatch):
    from seriesloom.operators import rolling

    given = [None, 4.0, 1.0, None, 9.0, 2.0, 2.0, INF, 3.0, None, 8.0, 5.0, 7.0, 1.0, 6.0, None, 2.0]
    p = column(spark, *given)
    p = p.define("some", F.col(p.values[0]) == 2.0).with_mask("some")
    for w in (2, 3, 5):
        for op in ("rolling_mean", "rolling_std", "rolling_mean_min2", "rolling_std_excl", "rolling_zscore", "ft_zscore", "ur"):
            out = []
            for wide in (1, 100):
                monkeypatch.setattr(rolling, "WIDE", wide)
                out.append(values(getattr(p, op)(w)))
            assert close(*out), (op, w)


def test_scores_of_a_whole_series_by_null_keys_too(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 9.0)], "k string, t int, x double")
    p = Panel.of(rows, "t", ["x"], ["k"]).zscore()
    assert sorted(round(r["x"], 6) for r in p.df.collect()) == [-0.707107, -0.707107, 0.707107, 0.707107]
