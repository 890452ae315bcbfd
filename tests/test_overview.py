"""What an overview shows, by hand and against SQL."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import overview
from tidemark.plans import overviews

DATA = "/root/testdata/sf0.001"
#: The smallest tables have too few days for a style.
LARGER = {"q_style_shown": "/root/testdata/sf0.01"}
TABLES = ["orders", "customer", "lineitem", "supplier", "part", "nation", "region", "events"]


def over(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(overviews.queries()))
def test_query_equals_sql(spark, name):
    data = LARGER.get(name, DATA)
    mine = overviews.queries()[name](spark, data)
    columns = sorted(mine.columns)
    theirs = over(data).execute(f"SELECT {', '.join(columns)} FROM ({overviews.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in mine.select(*columns).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, theirs))


def test_the_largest_and_the_worst_come_first_and_what_is_unknown_is_left_out(spark):
    positions = spark.createDataFrame([("p", "a", 50.0, 40.0), ("p", "b", 30.0, None), ("p", "c", 50.0, 80.0), ("q", "z", 0.0, 0.0), ("q", "y", None, 3.0)], "portfolio_id string, asset string, value double, cost double")
    stressed = spark.createDataFrame([("p", "s1", 5.0, 1.0), ("p", "s2", -9.0, 0.5), ("p", "s3", None, 0.0)], "portfolio_id string, scenario string, impact double, coverage double")
    rows = {(r.portfolio_id, r.panel, r.place): (r.label, r.bar, r.note) for r in overview.board(positions, stressed).collect()}
    assert [rows["p", "allocation", k][0] for k in (1, 2, 3)] == ["a", "c", "b"] and rows["p", "allocation", 3][2] == pytest.approx(30 / 130)
    assert rows["p", "gains", 1][:2] == ("a", pytest.approx(1 / 3)) and rows["p", "gains", 2] == ("c", 1.0, pytest.approx(-0.375)) and ("p", "gains", 3) not in rows
    assert rows["p", "stress", 1] == ("s2", 1.0, 0.5) and rows["p", "stress", 2] == ("s1", pytest.approx(5 / 9), None) and ("p", "stress", 3) not in rows
    assert rows["q", "allocation", 1] == ("z", 0.0, None) and rows["q", "gains", 1] == ("z", 0.0, None) and len([k for k in rows if k[0] == "q"]) == 2
    assert overview.board(positions.limit(0), stressed.limit(0)).count() == 0


def test_a_poor_fit_tells_no_error(spark):
    schema = "key string, lag int, n long, r2 double, tracking_error double, alpha double, information_ratio double, factor string, weight double"
    fit = lambda key, r2: [(key, 0, 200, r2, 0.1, 0.0, 1.5, f, w) for f, w in (("gold", 0.2), ("cash", 0.79), ("fx", 0.01))]
    rows = overview.shown_styles(spark.createDataFrame(fit("good", 0.30) + fit("poor", 0.29) + fit("none", None), schema)).collect()
    by = {(r.key, r.place): r for r in rows}
    assert len(rows) == 6 and all(by[k, 1].factor == "cash" and by[k, 2].factor == "gold" for k in ("good", "poor", "none"))
    assert by["good", 1].tracking_error == 0.1 and not by["good", 1].low_fit
    assert all(by[k, 1].low_fit and by[k, 1].tracking_error is None and by[k, 1].information_ratio is None for k in ("poor", "none"))


def test_parity_names_what_it_keeps_out(spark):
    parity = spark.createDataFrame([("p", "a", 0.4, False), ("p", "b", 0.6, False), ("p", "m", None, True), ("p", "k", None, True), ("q", "a", None, False)], "portfolio_id string, asset string, weight double, cash_like boolean")
    rows = overview.shown_parity(parity).orderBy("place").collect()
    assert [(r.asset, r.kept_out) for r in rows] == [("b", "k, m"), ("a", "k, m")]


def test_simple_rates_and_scales(spark):
    ratios = spark.createDataFrame([(0.5, math.log(1.395), None), (None, 0.0, 0.1)], "sharpe double, ann_return double, ann_rf double")
    assert [(round(r.ann_return, 9), r.ann_rf) for r in overview.shown_sharpe(ratios).collect()] == [(0.395, None), (0.0, pytest.approx(math.exp(0.1) - 1))]
    points = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", None), ("level", -5.0), ("level", -5.0), ("zero", 0.0), ("zero", 0.0), ("one", 1.0)], "k string, v double")
    got = {r.k: (r.low, r.high) for r in overview.line_scale(points, "k", "v").select("k", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")).collect()}
    assert got == {"a": (9.4, 20.6), "level": (-5.3, -4.7), "zero": (-0.06, 0.06)}
