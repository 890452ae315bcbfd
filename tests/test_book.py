"""Books of portfolios with calendars of their own: sets, the volatility's recursion, one VaR base, benchmarks, scenarios, styles."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocation, backtest, book, exposure, factors, panel, rates, risk

DAY = dt.date(2020, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=int(i))


def prices_of(spark, table: dict[str, dict[int, float]]):
    return spark.createDataFrame([(a, day(i), float(v)) for a, own in table.items() for i, v in own.items()], "asset string, d date, px double")


def made(seed: int, n: int, gaps: dict[str, int]) -> dict[str, dict[int, float]]:
    """Random walks on n days; an asset lacks every so many days."""
    rng = np.random.default_rng(seed)
    out = {}
    for a, skip in gaps.items():
        walk = 100 * np.exp(np.cumsum(rng.standard_t(4, n) * 0.01))
        out[a] = {i: float(walk[i]) for i in range(n) if not skip or i % skip}
    return out


def aligned(table: dict[str, dict[int, float]], assets: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame({a: pd.Series(table[a]) for a in assets}).dropna().sort_index()
    return np.log(frame / frame.shift(1)).dropna()


HELD = {"p": {"a": 2.0, "b": 1.0}, "q": {"a": 1.0, "b": 5.0}, "r": {"b": 1.0, "c": 2.0}, "s": {"a": 1.0, "nothing": 3.0}, "t": {"nothing": 1.0}}


@pytest.fixture(scope="module")
def table():
    return made(5, 900, {"a": 0, "b": 7, "c": 5})


@pytest.fixture(scope="module")
def own(spark, table):
    holdings = spark.createDataFrame([(p, a, x) for p, h in HELD.items() for a, x in h.items()], "portfolio_id string, asset string, quantity double")
    return book.Book(prices_of(spark, table | {"nothing": {0: 0.0}}), holdings, keep=lambda df, name: df.cache())


def series_of(table, held):
    assets = [a for a in held if a in table]
    value = np.array([held[a] * table[a][max(table[a])] for a in assets])
    r = aligned(table, assets)
    return r, value, (r * (value / value.sum())).sum(axis=1)


def test_portfolios_of_one_set_share_a_calendar_and_others_keep_theirs(own, table):
    of = {r.portfolio_id: r.set_id for r in own._sets[0].collect()}
    assert of["p"] == of["q"] and len({of["p"], of["r"], of["s"]}) == 3 and "t" not in of
    got = own.series.orderBy("portfolio_id", "i").toPandas()
    for p in ("p", "q", "r", "s"):
        _, _, want = series_of(table, HELD[p])
        mine = got[got.portfolio_id == p]
        assert [(d - DAY).days for d in mine["d"]] == list(want.index) and list(mine["i"]) == list(range(len(want))) and np.allclose(mine["r"], want)
    assert own.returns.groupBy("set_id").agg(F.countDistinct("asset")).count() == 3


def test_the_recursion_in_blocks_is_the_plain_one(spark):
    rng = np.random.default_rng(2)
    for n in (1, 29, 128, 129, 700):
        r = rng.normal(0, 0.02, n)
        got = risk.ewma_path(spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(r)], "portfolio_id string, i int, r double")).orderBy("i").toPandas()
        v = [r[:30].var() or 1e-8]
        for x in r[:-1]:
            v.append(0.94 * v[-1] + 0.06 * x * x)
        assert np.allclose(got["sigma"], np.sqrt(v), rtol=1e-12)
    flat = risk.ewma_path(spark.createDataFrame([("x", i, 0.0) for i in range(12_000)], "portfolio_id string, i int, r double"))
    assert flat.where("i = 0").first().sigma == pytest.approx(1e-4) and flat.where("sigma IS NULL OR isnan(sigma)").count() == 0


def test_all_figures_stand_on_the_headline_var(own, table):
    f = own.figures.toPandas().set_index("portfolio_id")
    assert set(f.index) == {"p", "q", "r", "s"}
    for p in f.index:
        r, value, s = series_of(table, HELD[p])
        assert f.loc[p, "var_historical"] == pytest.approx(np.quantile(s, 1 - 0.99)) and f.loc[p, "value"] == pytest.approx(value.sum())
        best = {"historical": "var_historical", "ewma": "var_ewma", "fhs": "var_fhs"}[f.loc[p, "model"]]
        assert f.loc[p, "var"] == pytest.approx(f.loc[p, best]) and f.loc[p, "scale"] == pytest.approx(f.loc[p, "var"] / f.loc[p, "var_historical"])
    parts = book.attribution(own).toPandas()
    for p in ("p", "q", "r"):
        mine = parts[parts.portfolio_id == p]
        assert mine["component"].sum() == pytest.approx(abs(f.loc[p, "var_value"]))
    assert parts[parts.portfolio_id == "s"]["component"].isna().all()
    d = book.diversification(own).toPandas().set_index("portfolio_id")
    assert np.allclose(d["portfolio_var"], f.loc[d.index, "var_value"])
    exits = exposure.liquidity(own.weights.select("portfolio_id", "asset", "value", F.lit("fund").alias("kind"), F.lit(None).cast("double").alias("adv")))
    lvar = book.liquidity_var(own, exits).toPandas().set_index("portfolio_id")
    assert np.allclose(lvar["lvar_value"], f.loc[lvar.index, "var_value"] * np.sqrt(2))


def test_without_a_backtest_the_historical_var_is_the_headline(spark):
    few = book.Book(prices_of(spark, made(1, 90, {"a": 0})), spark.createDataFrame([("p", "a", 1.0)], "portfolio_id string, asset string, quantity double"))
    f = few.figures.first()
    assert f.model == "historical" and f.zone is None and f.var == f.var_historical and f.scale == 1 and f.var_fhs is None and f.es is not None


def test_the_headline_takes_the_best_zone_then_the_higher_p_then_the_first(spark):
    rows = [("a", "historical", "yellow", 0.16), ("a", "ewma", "green", 0.38), ("a", "fhs", "green", 0.76), ("b", "historical", "red", 0.2), ("b", "ewma", "red", 0.2), ("b", "fhs", "red", 0.1)]
    rows += [("c", m, None, None) for m in backtest.MODELS]
    got = {r.portfolio_id: r.model for r in backtest.headline(spark.createDataFrame(rows, "portfolio_id string, model string, zone string, kupiec_p double")).collect()}
    assert got == {"a": "fhs", "b": "historical", "c": "historical"}


def test_benchmarks_by_choice(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0.001, 0.01, 400)
    days = [3 * i for i in range(400)]
    series = spark.createDataFrame([(p, day(d), i, float(x)) for p in "abcd" for i, (d, x) in enumerate(zip(days, r))], "portfolio_id string, d date, i int, r double")
    fx = {d: 10 * np.exp(0.0002 * d + 0.01 * np.sin(d)) for d in range(30, 1300) if d % 2 == 0}
    choices = spark.createDataFrame([("a", "deposit", 0.4), ("b", "usd", None), ("c", "eur", None)], "portfolio_id string, kind string, annual double")
    foreign = spark.createDataFrame([("usd", day(d), float(v)) for d, v in fx.items()], "kind string, d date, px double")
    change = np.log(pd.Series(fx) / pd.Series(fx).shift(1)).dropna()
    s = pd.Series(r, index=days)
    rows = rates.with_benchmark(series, choices, foreign)
    got = {(x.portfolio_id, x.horizon): x for x in rates.sharpe_by_choice(rows).collect()}
    tail = s.tail(252)
    want = (tail.mean() * 252 - np.log(1.4)) / (tail.std() * np.sqrt(252))
    assert got["a", 252].sharpe == pytest.approx(want) and got["a", 756].sharpe is None
    rf = change.reindex(tail.index).ffill().dropna()
    both = tail.loc[rf.index]
    assert got["b", 252].observations == len(both) and got["b", 252].sharpe == pytest.approx((both.mean() - rf.mean()) * 252 / (both.std() * np.sqrt(252)))
    assert got["c", 252].sharpe is None and got["d", 252].sharpe is None
    late = {(x.portfolio_id, x.horizon): x for x in rates.sharpe_by_choice(rates.with_benchmark(series, choices, foreign, asof=True)).collect()}
    rf = change.reindex(range(32, 1200)).ffill().reindex(tail.index).dropna()
    assert late["b", 252].ann_rf == pytest.approx(rf.mean() * 252) and late["b", 252].ann_rf != pytest.approx(got["b", 252].ann_rf)
    ci = {x.portfolio_id: x for x in rates.confidence_by_choice(rows, 0.3).collect()}
    for p, annual in (("a", 0.4), ("d", 0.3)):
        x = tail.to_numpy() - np.log(1 + annual) / 252
        sr = x.mean() / x.std()
        assert ci[p].sharpe == pytest.approx(sr * np.sqrt(252)) and ci[p].n == 252 and ci[p].low == pytest.approx(sr * np.sqrt(252) - 1.96 * np.sqrt((1 + sr * sr / 2) / 252 * 252))
    x = (tail - change.reindex(tail.index).ffill()).dropna()
    assert ci["b"].n == len(x) and ci["b"].skew == pytest.approx(((x - x.mean()) ** 3).mean() / x.std(ddof=0) ** 3)
    assert ci["c"].sharpe is None


def test_scenarios_are_a_table_with_regions_coverage_and_what_is_missing(spark):
    table = {"a": {i: 100 + i for i in range(60)}, "b": {i: 50 + (i % 9) for i in range(20, 60)}, "c": {i: 10.0 + i for i in range(60) if i != 31}}
    holdings = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", 1.0), ("q", "c", 1.0)], "portfolio_id string, asset string, quantity double")
    own = book.Book(prices_of(spark, table), holdings)
    scenarios = exposure.scenario_table(spark, [("early", day(0), day(10), "x"), ("late", day(30), day(35), "y"), ("none", "2030-01-01", "2030-03-01", "y"), ("wrong", day(9), day(3), "x")])
    got = {(r.portfolio_id, r.scenario): r for r in exposure.stress(own.prices, own.weights, scenarios).collect()}
    assert len(got) == 8
    early = got["p", "early"]
    value = {r.asset: r.value for r in own.weights.where("portfolio_id = 'p'").collect()}
    assert early.cumulative_return == pytest.approx(110 / 100 - 1) and early.missing_assets == ["b"] and early.coverage == pytest.approx(value["a"] / (value["a"] + value["b"])) and early.impact == pytest.approx(value["a"] * 0.1)
    late = got["q", "late"]
    assert late.n_days == 3  # the day without c, and the day after, drop out for both
    w = {r.asset: r.w for r in own.weights.where("portfolio_id = 'q'").collect()}
    r = {a: sum(np.log(table[a][i] / table[a][i - 1]) for i in (33, 34, 35)) for a in "ac"}
    assert late.cumulative_return == pytest.approx(np.exp(w["a"] * r["a"] + w["c"] * r["c"]) - 1) and late.missing_assets == [] and late.coverage == 1
    for s in ("none", "wrong"):
        assert got["p", s].cumulative_return is None and got["p", s].coverage == 0 and got["p", s].missing_assets == ["a", "b"] and got["p", s].impact is None
    assert {r.scenario for r in exposure.stress(own.prices, own.weights, scenarios, ["y"]).collect()} == {"late", "none"}


def test_funds_are_looked_through_up_to_the_whole(spark):
    rng = np.random.default_rng(3)
    f, g = rng.normal(0, 0.01, 300), rng.normal(0, 0.005, 300)
    series = spark.createDataFrame([("p", i, day(i), float(0.5 * x + y)) for i, (x, y) in enumerate(zip(f, g))], "portfolio_id string, i int, d date, r double")
    weights = spark.createDataFrame([("p", "gold", 0.5, 50.0), ("p", "fund", 0.5, 50.0), ("q", "gold", 0.9, 9.0), ("q", "fund", 0.1, 1.0)], "portfolio_id string, asset string, w double, value double")
    styles = spark.createDataFrame([("fund", "usd", 0.2), ("fund", "cash", 0.8), ("other", "usd", 1.0), ("gold", "usd", -0.4)], "key string, factor string, weight double")
    indirect = exposure.looked_through(weights, styles, "usd")
    assert {r.portfolio_id: r.indirect for r in indirect.collect()} == pytest.approx({"p": 0.1, "q": 0.02})
    fx = spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(f)], "d date, f double")
    got = {r.portfolio_id: r for r in exposure.currency_split(series, weights, fx, ["gold"], indirect).collect()}
    assert got["p"].exposure == pytest.approx(0.6) and got["p"].fx_share == pytest.approx(0.36 * f.var(ddof=1) / (0.5 * f + g).var(ddof=1)) and got["q"].exposure is None
    full = exposure.currency_split(series, weights, fx, ["gold"], indirect.withColumn("indirect", F.lit(0.9)))
    assert full.where("portfolio_id = 'p'").first().exposure == 1


def test_style_factors_lose_only_their_own_days(spark):
    table = {"BIST": {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0, 4: 16.0}, "OUNCE": {0: 10.0, 1: 20.0, 3: 20.0, 4: 10.0}, "USD": {0: 5.0, 2: 10.0, 3: 10.0, 4: 20.0}}
    interest = spark.createDataFrame([(day(1), 0.2), (day(9), 0.9)], "d date, rate double")
    got = factors.style_panel(prices_of(spark, table), {"bist": "BIST", "usd": "USD"}, {"gold": "OUNCE"}, "USD", interest)
    f = {(r.factor, (r.d - DAY).days): r.f for r in got.collect()}
    two = np.log(2)
    assert f == pytest.approx({**{("bist", i): two for i in (1, 2, 3, 4)}, ("usd", 3): 0.0, ("usd", 4): two, ("gold", 1): two, ("gold", 4): 0.0, **{("cash", i): np.log(1.2) / 252 for i in (1, 2, 3, 4)}})
    idle = factors.style_panel(prices_of(spark, table), {"bist": "BIST"}, {}, "USD")
    assert {r.f for r in idle.where("factor = 'cash'").collect()} == {np.log(1.4) / 252}


def test_pair_moments_meet_within_sets_alone(spark, own, table):
    m = allocation.pair_moments(own.returns)
    sets = {r.portfolio_id: r.set_id for r in own._sets[0].collect()}
    got = {(r.set_id, r.a, r.b): r for r in m.collect()}
    assert len(got) == 4 + 4 + 1
    r = aligned(table, ["b", "c"])
    assert got[sets["r"], "b", "c"].s == pytest.approx(np.cov(r["b"], r["c"], ddof=0)[0, 1]) and got[sets["r"], "b", "c"].n == len(r)
    assert ("b", "c") not in {(a, b) for s, a, b in got if s != sets["r"]}
    top = risk.tail_pairs(own.returns, least=100)
    assert top.count() == 2 and panel.held_returns(own.prices, own.holdings).count() > 0


def test_quantiles_of_portfolios_make_no_row_for_a_portfolio_and_day(spark):
    rng = np.random.default_rng(6)
    prices = spark.createDataFrame([(a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(np.exp(rng.normal(0, 0.02)))) for a in "abc" for i in range(200) if (i + ord(a)) % 9], "asset string, d date, px double")
    rows = [(f"p{i}", a, float(rng.integers(1, 9))) for i in range(25) for a in "abc" if (i >> "abc".index(a)) & 1] + [("short", "a", 0.0)]
    own = book.Book(prices, spark.createDataFrame(rows, "portfolio_id string, asset string, quantity double"))
    found = panel.portfolio_quantiles(own.returns, own.weights, 0.01, 2)  # lots of about two
    got = {r.portfolio_id: (r.n, r.q) for r in found.collect()}
    want = {r.portfolio_id: (r.n, r["var"]) for r in risk.historical_var(own.series).collect()}
    assert got.keys() == want.keys() and got["short"] == (0, None) and all(got[k][0] == n and got[k][1] == pytest.approx(v, abs=1e-12) for k, (n, v) in want.items())
