"""The store of versions, documents and their orders, reports, simulations, rules and the writing of numbers."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import locale
from tidemark.operators import documents, panel, reports, valuation
from tidemark.sources import snapshots
from tidemark.sources.store import Conflict, Store

DAY = dt.date(2020, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=int(i))


def test_a_snapshot_of_one_asset_leaves_the_others(spark, tmp_path):
    at = str(tmp_path / "s")
    of = lambda **own: spark.createDataFrame([(a, day(i), float(v)) for a, x in own.items() for i, v in x.items()], "asset string, d date, px double")
    assert snapshots.load(spark, at).count() == 0
    snapshots.save(of(a={0: 1}, b={0: 2, 1: 3}), at)
    before = snapshots.load(spark, at)
    got = snapshots.refreshed(of(a={5: 9}), at)
    assert sorted((r.asset, r.px) for r in got.collect()) == [("a", 9.0), ("b", 2.0), ("b", 3.0)]
    assert sorted((r.asset, r.px) for r in snapshots.load(spark, at).collect()) == [("a", 9.0), ("b", 2.0), ("b", 3.0)]
    assert sorted(r.px for r in before.collect()) == [1.0, 2.0, 3.0]  # a frame keeps to its state
    snapshots.save(snapshots.load(spark, at).withColumn("px", F.col("px") + 1), at)  # a table is written from itself
    assert sorted(r.px for r in snapshots.load(spark, at).collect()) == [3.0, 4.0, 10.0]


def test_portfolios_are_replaced_emptied_and_kept(spark, tmp_path):
    kinds, at = "portfolio_id string, name string, quantity double", str(tmp_path / "p")
    rows = lambda *x: spark.createDataFrame(list(x), kinds)
    now = lambda: sorted((r.portfolio_id or "", r.name) for r in snapshots.portfolios(spark, at, kinds).collect())
    snapshots.replace_portfolios(rows(("p", "a", 1.0), ("p", "b", 1.0), ("q", "c", 1.0), (None, "n", 1.0)), at)
    snapshots.replace_portfolios(rows(("p", "z", 2.0)), at)
    assert now() == [("", "n"), ("p", "z"), ("q", "c")]
    snapshots.replace_portfolios(rows(), at, spark.createDataFrame([("q",), ("unknown",)], "portfolio_id string"))
    assert now() == [("", "n"), ("p", "z")]
    snapshots.replace_portfolios(rows(("q", "new", 1.0)), at)
    store = Store(spark, at, "portfolio_id", kinds)
    store.compact()
    assert len(store._log()) == 1 and now() == [("", "n"), ("p", "z"), ("q", "new")]
    assert store.vacuum() == 4 and now() == [("", "n"), ("p", "z"), ("q", "new")] and store.vacuum() == 0
    store.replace(rows(("p", "last", 1.0)))
    assert now() == [("", "n"), ("p", "last"), ("q", "new")]


def test_two_writers_cannot_take_one_version_and_a_failed_one_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"), "k", "k string, v int")
    store.replace(spark.createDataFrame([("a", 1)], "k string, v int"))
    with pytest.raises(Conflict):
        store._commit(1, "delta", "other")
    with pytest.raises(Exception):
        store.replace(spark.createDataFrame([("a", 2)], "k string, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int")))
    assert [(r.k, r.v) for r in store.read().collect()] == [("a", 1)]
    assert store.replace(spark.createDataFrame([("a", 3)], "k string, v int")) == 2


def test_blocks_keep_their_order_and_failed_ones_are_null(spark):
    rows = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 3.0), ("p", "w", 3.0), ("p", "v", None), ('q"', "z", 0.1234567)], "portfolio_id string, name string, v double")
    down = documents.listed("down", rows, [F.col("v").isNull(), -F.col("v"), F.col("name")], "name", "v")
    one = documents.single("one", rows.groupBy("portfolio_id").agg(F.max("v").alias("v"), F.when(F.max("v") > 1, F.lit("s")).alias("s")).where("v > 1"), "v", "s")
    names = spark.createDataFrame([("p",), ('q"',), ("r",)], "portfolio_id string")
    got = {r.portfolio_id: r.document for r in documents.document(names, [down, one], ["one", "down", "never"]).collect()}
    assert got["p"] == '{"portfolio_id":"p","one":{"v":3.000000,"s":"s"},"down":[{"name":"w","v":3.000000},{"name":"y","v":3.000000},{"name":"x","v":1.000000},{"name":"v","v":null}],"never":null}'
    assert got['q"'] == '{"portfolio_id":"q\\"","one":null,"down":[{"name":"z","v":0.123457}],"never":null}'
    assert json.loads(got["r"]) == {"portfolio_id": "r", "one": None, "down": None, "never": None}


def test_numbers_as_people_write_them(spark):
    values = [1234567.5, -1234.5, 0.4, 0.0, None, 1e9]
    rows = spark.createDataFrame([(v, lang) for v in values for lang in ("tr", "en", None)], "v double, lang string")
    got = {(r.v, r.lang): (r.m, r.p) for r in rows.select("v", "lang", locale.money(F.col("v"), F.col("lang")).alias("m"), locale.percent(F.col("v") / 100, F.col("lang")).alias("p")).collect()}
    for v in values[:4] + values[5:]:
        plain = f"{v:,.0f}".replace("-0", "0") if abs(v) < 0.5 else f"{v:,.0f}"
        share = f"{v / 100 * 100:+.2f}%"
        assert got[v, "en"] == (plain + " TRY", share)
        assert got[v, "tr"] == got[v, None] == (plain.replace(",", ".") + " TL", share.replace(".", ","))
    assert got[None, "en"] == (None, None)
    texts = spark.createDataFrame([("1,5",), (" 2.25 ",), ("x",), ("",), (None,), ("-3",)], "t string")
    assert [r.x for r in texts.select(locale.parsed(F.col("t")).alias("x")).collect()] == [1.5, 2.25, None, None, None, -3.0]


def test_rules_name_all_that_is_wrong(spark):
    kinds = "portfolio_id string, name string, ticker string, currency string, source string, quantity double, cost double"
    rows = [("p", "a", "A", "USD", "yahoo", 1.0, None), ("p", " ", "B", "EUR", "other", 0.0, -1.0), ("p", None, "C", None, None, None, 1.0)] + [("many", "n", "N", "TRY", "tefas", 1.0, 1.0)] * 51
    positions = spark.createDataFrame(rows, kinds)
    got = valuation.problems(positions, valuation.POSITION_RULES)
    assert {r.ticker: r.problems for r in got.collect()} == {"A": [], "B": ["quantity", "currency", "source", "name"], "C": ["quantity", "currency", "source", "name"], "N": ["count"]}
    assert sorted((r.ticker, r.cost) for r in valuation.tidied(positions.where("portfolio_id = 'p'").withColumn("quantity", F.coalesce("quantity", F.lit(2.0)))).collect()) == [("A", None), ("C", 1.0)]
    bond = spark.createDataFrame([("p", 100.0, 95.0, 0.0, 2.0, 0.1, 2), ("q", 0.0, -1.0, -0.1, 0.0, 0.0, 0)], "portfolio_id string, nominal double, price double, coupon double, years double, ytm double, frequency int")
    assert [r.problems for r in valuation.problems(bond, valuation.BOND_RULES).orderBy("portfolio_id").collect()] == [[], ["nominal", "price", "coupon", "years", "ytm", "frequency"]]
    asked = spark.createDataFrame(
        [(0.99, 0.4, "rate", day(0), day(9), day(9), 1, 0), (0.5, 4.0, "gold", day(9), day(9), day(1), 0, 0), (0.95, None, None, None, None, day(1), 0, 1)],
        "confidence double, annual double, kind string, start date, end date, today date, positions int, bonds int",
    )
    assert [r.problems for r in valuation.problems(asked, valuation.REQUEST_RULES).collect()] == [[], ["confidence", "rate", "kind", "dates", "future", "empty"], []]
    tickers = spark.createDataFrame([("A", "yahoo"), ("A", "yahoo"), ("TRY=X", "yahoo"), ("BTC-USD", "yahoo"), ("GRAM", "yahoo"), ("F", "tefas")], "ticker string, source string")
    assert [r.ticker for r in valuation.equity_tickers(tickers, "GRAM").collect()] == ["A"]


def test_names_belong_to_their_portfolio(spark):
    kinds = "portfolio_id string, name string, kind string, ticker string, currency string, source string, quantity double, cost double"
    positions = spark.createDataFrame([("p", "same", "market", "X", "TRY", "quote", 1.0, None), ("q", "same", "market", "Y", "USD", "quote", 2.0, None)], kinds)
    quotes = spark.createDataFrame([("X", day(0), 3.0), ("Y", day(0), 5.0), ("FX", day(0), 10.0)], "asset string, d date, px double")
    last = valuation.local_prices(quotes, positions, "FX", "G", valuation.INSTRUMENT).groupBy(*valuation.INSTRUMENT).agg(F.max_by("native", "d").alias("last"))
    now = valuation.rate_now(quotes, "FX")
    market = valuation.position_values(positions, last, now, valuation.INSTRUMENT)
    assert {r.portfolio_id: r.local_value for r in market.collect()} == {"p": 3.0, "q": 100.0}
    bonds = spark.createDataFrame([(p, "bond", "TRY", 1000.0, x, None, 1.0, 2.0, 1.5, 0.1) for p, x in (("p", 90.0), ("q", 95.0))], "portfolio_id string, name string, currency string, nominal double, price double, cost double, fair double, macaulay double, modified double, ytm double")
    both = valuation.with_bonds(market, bonds, now).where("kind = 'bond'")
    assert sorted((r.portfolio_id, r.value, r.modified) for r in both.collect()) == [("p", 900.0, 1.5), ("q", 950.0, 1.5)]
    with pytest.raises(Exception, match="no rate of exchange"):
        valuation.rate_now(quotes, "none", required=True).collect()


def test_reports_in_both_languages(spark):
    kinds = "portfolio_id string, place int, name string, kind string, quantity double, local_value double, pnl_pct double, failed boolean"
    rows = [("p", 0, "a", "market", 2.0, 1500.0, 25.0, False), ("p", 1, "b", "market", 1.0, None, None, True), ("p", 2, "c", "market", 4.0, 3000.0, -5.0, False), ("p", 3, "d", "bond", 1000.0, 900.0, 2.0, False), ("none", 0, "b", "market", 1.0, None, None, True)]
    changes = spark.createDataFrame([("a", 0.0125), ("c", -0.5), ("d", 0.3)], "name string, change double")
    made = reports.report_rows(spark.createDataFrame(rows, kinds), changes)
    totals = reports.report_totals(made)
    assert [(r.portfolio_id, r.total, r.bonds, r.market, r.n_priced) for r in totals.collect()] == [("p", 5400.0, 900.0, 4500.0, 2)]
    stats = spark.createDataFrame([("p", 0.01, 62.5, -0.02, None)], "portfolio_id string, ret double, percentile double, var_now double, var_prev double")
    (got,) = documents.report(made, totals, stats, "tr").collect()
    doc = json.loads(got.document)
    assert doc["totals"] == {"total": "5.400 TL", "bonds": "900 TL", "n_priced": 2} and doc["statistics"] == {"ret": "+1,00%", "percentile": 62, "var_now": "-2,00%", "var_prev": None}
    assert [(r["name"], r["value"], r["moved"], r["result"], r["priced"]) for r in doc["rows"]] == [("a", "1.500 TL", "+1,25%", "+25,00%", True), ("b", None, None, None, False), ("c", "3.000 TL", "-50,00%", "-5,00%", True), ("d", "900 TL", None, None, True)]
    assert [r["name"] for r in doc["allocation"]] == ["c", "a", "d"] and [r["name"] for r in doc["gains"]] == ["a", "c"]
    assert json.loads(documents.report(made, totals, stats, "en").first().document)["rows"][0]["value"] == "1,500 TRY"


def test_simulations_keep_the_path_of_what_is_covered(spark):
    rng = np.random.default_rng(4)
    a = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))
    table = {"a": dict(enumerate(a)), "late": {i: 5.0 for i in range(390, 400)}}
    prices = spark.createDataFrame([(n, day(i), float(v)) for n, x in table.items() for i, v in x.items()], "asset string, d date, px double")
    holdings = spark.createDataFrame([("p", "a", 10.0), ("p", "late", 1.0), ("q", "late", 1.0)], "portfolio_id string, asset string, quantity double")
    w = panel.weights(holdings, prices, panel.asset_sets(prices, holdings)[0])
    got = {r.portfolio_id: json.loads(r.document) for r in documents.simulation(prices, w, str(day(0)), str(day(379))).collect()}
    doc, base = got["p"], 10 * a[399]
    assert doc["missing_assets"] == {"missing_assets": ["late"]} and doc["result"]["base_value"] == pytest.approx(base) and doc["result"]["cumulative_return"] == pytest.approx(a[379] / a[0] - 1, abs=1e-6)
    assert doc["result"]["final_value"] == pytest.approx(base * a[379] / a[0]) and doc["series"][0] == {"date": "2020-01-01", "value": pytest.approx(base)}
    assert [x["date"] for x in doc["series"]] == [str(day(i)) for i in range(0, 380, 2)] + [str(day(379))]
    assert got["q"]["result"] is None and got["q"]["series"] is None and got["q"]["missing_assets"] == {"missing_assets": ["late"]}
    even = json.loads(documents.simulation(prices, w, str(day(0)), str(day(378))).where("portfolio_id = 'p'").first().document)
    assert [x["date"] for x in even["series"][-2:]] == [str(day(378))] * 2  # the last point stands twice where thinning has kept it


def test_simulations_start_from_a_sum_that_no_order_of_rows_changes(spark):
    prices = spark.createDataFrame([(a, day(i), 1.0) for a in "abc" for i in range(3)], "asset string, d date, px double")
    holdings = spark.createDataFrame([("p", "a", 1e16), ("p", "b", 1.0), ("p", "c", 1.0)], "portfolio_id string, asset string, quantity double")  # one at a time, the ones are lost
    w = panel.weights(holdings, prices, panel.asset_sets(prices, holdings)[0])
    text = documents.simulation(prices, w, str(day(0)), str(day(2)), money=2).first().document
    assert '"base_value":10000000000000002.00,' in text and '{"date":"2020-01-01","value":10000000000000002.00}' in text
