"""Currencies, reports, rates, factors, make-up of portfolios and snapshots, on small made-up panels against plain computations."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocation, factors, rates, reports, risk, structure, valuation
from tidemark.sources import snapshots

DAY = dt.date(2020, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def long(spark, table: dict[str, dict[int, float]], names=("asset", "d", "px")):
    rows = [(a, day(i), float(v)) for a, own in table.items() for i, v in own.items()]
    return spark.createDataFrame(rows, f"{names[0]} string, d date, {names[2]} double")


def test_prices_are_converted_at_the_last_rate_and_gold_by_the_gram(spark):
    quotes = long(spark, {"FX": {1: 10, 3: 20}, "US": {0: 5, 1: 6, 2: 7}, "OUNCE": {2: 31.1034768, 3: 0}, "LOCAL": {0: 3}, "FUND": {2: 9}})
    rows = [("us", "US", "USD", "quote"), ("gold", "x", "TRY", "gram"), ("local", "LOCAL", "TRY", "quote"), ("fund", "FUND", "USD", "fund"), ("lost", "NONE", "TRY", "quote")]
    got = valuation.local_prices(quotes, spark.createDataFrame(rows, "name string, ticker string, currency string, source string"), "FX", "OUNCE")
    got = {(r.name, (r.d - DAY).days): r.px for r in got.where("px IS NOT NULL").collect()}
    assert got == pytest.approx({("us", 1): 60, ("us", 2): 70, ("gold", 2): 10, ("local", 0): 3, ("fund", 2): 9})


def test_values_totals_and_documents(spark):
    rows = [("p", "a", "market", "USD", 2.0, 4.0), ("p", "b", "market", "TRY", 3.0, None), ("p", "c", "market", "TRY", 1.0, 1.0), ("q", "c", "market", "TRY", 1.0, 0.0)]
    positions = spark.createDataFrame(rows, "portfolio_id string, name string, kind string, currency string, quantity double, cost double")
    last, now = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "name string, last double"), spark.createDataFrame([(10.0,)], "rate_now double")
    market = valuation.position_values(positions, last, now)
    a = market.where("name = 'a'").first()
    assert (a.value, a.cost_total, a.pnl, a.pnl_pct, a.local_value, a.local_pnl) == (10, 8, 2, 25, 100, 20)
    b = market.where("name = 'b'").first()
    assert b.value == 21 and b.pnl is None and b.pnl_pct is None
    bond = spark.createDataFrame([("p", "z", "TRY", 1000.0, 90.0, 80.0, 91.0, 2.0, 1.5, 0.3)], "portfolio_id string, name string, currency string, nominal double, price double, cost double, fair double, macaulay double, modified double, ytm double")
    totals = {r.portfolio_id: r for r in valuation.totals(valuation.with_bonds(market, bond, now)).collect()}
    p = totals["p"]
    assert (p.total, p.market, p.bonds, p.pnl, p.failed, p.coverage, p.duration) == (1021, 121, 900, 120, "c", 0.75, 1.5)
    assert totals["q"].total is None and totals["q"].failed == "c"
    made = {r.portfolio_id: r.document for r in valuation.documents(market).collect()}
    assert made["q"] == '{"portfolio_id":"q","valuation":[],"failed_assets":["c"]}'
    assert '"local_pnl":null' in made["p"]
    assert [r.problem for r in valuation.accepted(positions.where("name = 'a'").union(positions.where("name = 'a'").replace(2.0, -1.0))).orderBy("quantity").collect()] == ["quantity", None]


def test_period_reports_match_plain_ones(spark):
    rng = np.random.default_rng(1)
    days = [i for i in range(900) if i % 7 < 5]
    a, b = (dict(zip(days, np.exp(np.cumsum(rng.normal(0, 0.01, len(days)))))) for _ in range(2))
    b = {i: v for i, v in b.items() if i > 20 and i % 3}
    holdings = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 3.0), ("p", "none", 1.0), ("few", "a", 1.0)], "portfolio_id string, asset string, quantity double")
    values = reports.value_series(long(spark, {"a": a, "b": b}), holdings)
    frame = pd.DataFrame({"a": pd.Series(a), "b": pd.Series(b)}).ffill().dropna()
    want = frame["a"] * 2 + frame["b"] * 3
    got = values.where("portfolio_id = 'p'").orderBy("d").toPandas()
    assert [(d - DAY).days for d in got["d"]] == list(want.index) and np.allclose(got["value"], want)
    want.index = pd.to_datetime([day(i) for i in want.index])
    stats = {r.period: r for r in reports.period_stats(values.where("portfolio_id = 'p'")).collect()}
    logs = np.log(want / want.shift(1)).dropna()
    for name, (n, back) in reports.PERIODS.items():
        moved = (want.pct_change(1) if back is None else want.resample("D").ffill().pct_change(back)).dropna()
        s = stats[name]
        assert s.ret == pytest.approx(moved.iloc[-1]) and s.percentile == pytest.approx((moved.iloc[:-1] < moved.iloc[-1]).mean() * 100)
        assert s.var_now == pytest.approx(np.percentile(logs, 1)) and s.var_prev == pytest.approx(np.percentile(logs.iloc[:-n], 1))
    assert reports.period_stats(values.limit(3)).count() == 0


def test_observations_of_any_date_form(spark):
    doc = '{"items":[{"Tarih":"02-01-2020","V":"1.5"},{"Tarih":"2020-3","V":"2"},{"Tarih":"2020-04-05","V":"3"},{"Tarih":"2020-05-05","V":"null"},{"Tarih":"x","V":"1"},{"Tarih":"2020-06-01","V":""},{"Tarih":"2020-06-02","V":"?"}]}'
    got = rates.observations(spark.createDataFrame([("s", doc), ("s", "{"), ("s", None)], "series string, doc string"), "V")
    assert sorted((r.d.isoformat(), r.v) for r in got.collect()) == [("2020-01-02", 1.5), ("2020-03-01", 2.0), ("2020-04-05", 3.0)]
    last = rates.latest_rates(got).first()
    assert (last.gross, last.net) == pytest.approx((0.03, 0.03 * 0.85))


def test_sharpe_over_a_series_loses_rates_of_other_days(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.001, 0.01, 200)
    series = spark.createDataFrame([("p", day(2 * i), i, float(x)) for i, x in enumerate(r)], "portfolio_id string, d date, i int, r double")
    rf = spark.createDataFrame([(day(k), v) for k, v in ((1, 9.0), (20, 0.0001), (300, 0.0002))], "d date, rf double")
    got = {x.horizon: x for x in rates.sharpe_over_series(series, rf).collect()}
    kept, f = r[10:], np.where(np.arange(10, 200) < 150, 0.0001, 0.0002)
    assert got[252].observations == 190 and got[252].sharpe == pytest.approx((kept.mean() - f.mean()) * 252 / (kept.std(ddof=1) * np.sqrt(252)))
    assert got[756].sharpe is None
    chosen = spark.createDataFrame([(0.4,), (-2.0,), (None,)], "annual double").select(rates.daily_rate(F.col("annual")).alias("x"))
    assert [r.x for r in chosen.collect()] == [pytest.approx(np.log(1.4) / 252), pytest.approx(np.log(0.01) / 252), None]


def test_betas_and_styles_find_weights_and_lag(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 0.01, (400, 3))
    y = np.roll(f @ np.array([0.6, 0.4, 0.0]), 1) + rng.normal(0, 0.0005, 400) + 0.0002
    names = ["x", "y", "z"]
    panel = spark.createDataFrame([(n, day(i), float(f[i, k])) for k, n in enumerate(names) for i in range(400)], "factor string, d date, f double")
    targets = spark.createDataFrame([("k", day(i), float(v)) for i, v in enumerate(y)] + [("short", day(i), 0.1) for i in range(50)], "key string, d date, r double")
    sums = factors.moments(targets, panel, names, 1).cache()
    got = factors.betas(sums, names).toPandas().set_index("factor")
    x = np.column_stack([np.ones(399), f[:-1]])
    want = np.linalg.lstsq(x, y[1:], rcond=None)[0][1:]
    assert set(got["key"]) == {"k"} and set(got["lag"]) == {1} and np.allclose(got.loc[names, "beta"], want)
    left = y[1:] - x @ np.linalg.lstsq(x, y[1:], rcond=None)[0]
    assert np.allclose(got["r2"], 1 - left @ left / ((y[1:] - y[1:].mean()) ** 2).sum())
    mix = factors.style(sums, names).toPandas().set_index("factor")
    w = mix.loc[names, "weight"].to_numpy()
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and np.allclose(w, [0.6, 0.4, 0], atol=0.03) and set(mix["lag"]) == {1}
    cost = lambda v: ((y[1:] - f[:-1] @ v) ** 2).sum()
    assert all(cost(w) <= cost(v) + 1e-12 for v in rng.dirichlet(np.ones(3), 2000))
    rest = y[1:] - f[:-1] @ w
    assert mix["tracking_error"].iloc[0] == pytest.approx(rest.std() * np.sqrt(252)) and mix["alpha"].iloc[0] == pytest.approx(rest.mean() * 252)


def panel_of(spark, r: np.ndarray, names: list[str]):
    returns = spark.createDataFrame([(n, day(i), float(r[i, k])) for k, n in enumerate(names) for i in range(len(r))], "asset string, d date, r double")
    weights = spark.createDataFrame([("p", n, 1.0, 1 / len(names)) for n in names] + [("single", names[0], 1.0, 1.0)], "portfolio_id string, asset string, value double, w double")
    return returns, weights


def test_parity_by_hierarchy_on_two_clusters(spark):
    rng = np.random.default_rng(4)
    one, two = rng.normal(0, 0.01, (2, 500))
    noise = rng.normal(0, 0.002, (4, 500))
    r = np.column_stack([one + noise[0], two * 2 + noise[1], one + noise[2], two * 2 + noise[3], rng.normal(0, 0.0001, 500)])
    returns, weights = panel_of(spark, r, list("abcde"))
    got = {(x.portfolio_id, x.asset): x for x in structure.hierarchical_parity(allocation.pair_moments(returns), weights).collect()}
    w = {a: got["p", a].weight for a in "abcd"}
    cov = np.cov(r[:, :4], rowvar=False)
    sub = lambda p: (lambda iv: (iv / iv.sum()) @ cov[np.ix_(p, p)] @ (iv / iv.sum()))(1 / np.diag(cov)[p])
    left, right = sub([0, 2]), sub([1, 3])
    share = 1 - left / (left + right)
    assert w["a"] + w["c"] == pytest.approx(share) and w["a"] / w["c"] == pytest.approx(cov[2, 2] / cov[0, 0]) and sum(w.values()) == pytest.approx(1)
    assert got["p", "e"].cash_like and got["p", "e"].weight is None and got["single", "a"].weight is None


def test_linkage_takes_the_nearest_clusters(spark):
    d = np.array([[0, 9, 1, 7], [9, 0, 8, 2], [1, 8, 0, 3], [7, 2, 3, 0.0]])
    assert structure._leaf_order(d) == [0, 2, 1, 3]
    assert structure._leaf_order(np.array([[0, 5, 1], [5, 0, 6], [1, 6, 0.0]])) == [0, 2, 1]


def test_concentration_counts_bets(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.01, (800, 4))
    r[:, 3] = r[:, 2] + rng.normal(0, 1e-4, 800)
    returns, weights = panel_of(spark, r, list("abcd"))
    moments = allocation.pair_moments(returns)
    got = {x.portfolio_id: x for x in structure.concentration(moments, allocation.shrunk_covariance(moments, weights), weights).collect()}
    e = np.linalg.eigvalsh(np.corrcoef(r, rowvar=False))
    e = e[e > 1e-10] / e[e > 1e-10].sum()
    assert got["p"].effective_bets == pytest.approx(np.exp(-(e * np.log(e)).sum())) and got["p"].hhi == pytest.approx(0.25)
    assert got["single"].effective_bets is None and got["single"].hhi is None


def test_expected_drawdown_is_the_median_of_resampled_paths(spark):
    r = np.random.default_rng(6).normal(0, 0.01, 130)
    rows = [("p", i, float(x)) for i, x in enumerate(r)] + [("few", i, 0.1) for i in range(10)]
    got = {x.portfolio_id: x.expected_drawdown for x in structure.expected_drawdown(spark.createDataFrame(rows, "portfolio_id string, i int, r double").repartition(3)).collect()}
    p, falls, rows = 2_147_483_647, [], []
    for k in range(400):
        x = [((k + 1) * 104_729 + (t + 1) * 15_485_863 + 12_345) % p for t in range(130)]
        z = [v * v % p * ((v + 12_345) % p) % p for v in x]
        rows.append([(a * a + b) % p * 130 // p for a, b in zip(z, x)])
        c = np.exp(np.cumsum(r[rows[-1]]))
        falls.append(min(c[j] / c[: j + 1].max() - 1 for j in range(130)))
    assert got["p"] == pytest.approx(np.median(falls)) and got["few"] is None
    rows = np.array(rows)
    assert abs(np.corrcoef(rows[:, :-1].ravel(), rows[:, 1:].ravel())[0, 1]) < 0.02 and abs(rows.mean() - 64.5) < 1 and rows.std() == pytest.approx(130 / np.sqrt(12), rel=0.01)
    draw = np.random.default_rng(0)
    chance = [min((lambda c: c / np.maximum.accumulate(c) - 1)(np.exp(np.cumsum(draw.choice(r, size=130))))) for _ in range(4000)]
    assert got["p"] == pytest.approx(np.median(chance), rel=0.08)


def test_tail_pairs_keep_those_that_never_fall_together(spark):
    i = np.arange(400)
    r = np.column_stack([np.where(i < 20, -1.0, i / 1e4), np.where((i >= 20) & (i < 40), -1.0, i / 1e4), np.where(i < 20, -2.0, -i / 1e4)])
    returns, _ = panel_of(spark, r, list("abc"))
    got = {(x.a, x.b): x for x in risk.tail_pairs(returns).collect()}
    assert len(got) == 3 and got["a", "b"].co_exceedances == 0 and got["a", "c"].tail_lambda == pytest.approx(1) and got["a", "c"].tail_obs == 20
    assert got["a", "b"].pearson == pytest.approx(np.corrcoef(r[:, 0], r[:, 1])[0, 1]) and risk.tail_pairs(returns.where("asset < 'c'").limit(299)).count() == 0


def test_real_impact_takes_off_what_reaches_prices(spark):
    grid = spark.createDataFrame([("p", "s", -0.1, -10.0), ("p", "t", 0.2, 20.0)], "portfolio_id string, scenario string, change double, impact double")
    got = {x.scenario: x.change_real for x in factors.real_impact(grid, [("s", "fx", 0.5), ("s", "y", 1.0), ("t", "y", 1.0)], "fx").collect()}
    assert got == pytest.approx({"s": -0.3, "t": 0.2})


def test_search_and_recipients(spark):
    universe = spark.createDataFrame([("Alpha", "x"), ("alphabet", "y"), ("ALPHA two", "z"), ("beta", "x")], "name string, category string")
    got = reports.search(universe, spark.createDataFrame([("alphabet",)], "name string"), "ALPH", ["x", "y"])
    assert [r.name for r in got.collect()] == ["Alpha"]
    rows = [(1, 1, "", "a@x.org", True, True), (2, 2, "Bo", "b@x.org", True, True), (3, 3, None, "c@x.org", True, False), (4, 4, None, "d@x.org", False, True), (5, 5, None, "e@x.org", True, True)]
    users = spark.createDataFrame(rows, "user_id long, portfolio_id long, nickname string, email string, verified boolean, weekly boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "portfolio_id long")
    assert sorted((r.user_id, r.shown) for r in reports.recipients(users, ids(1, 1, 3, 4), ids(2), "weekly").collect()) == [(1, "a"), (2, "Bo")]


def test_snapshots(spark, tmp_path):
    first = spark.createDataFrame([("a", day(0), 1, 5.0), ("a", day(0), 2, 6.0), ("b", day(0), 1, 0.0)], "asset string, d date, seq int, px double")
    second = spark.createDataFrame([("a", day(1), 1, 9.0), ("b", day(1), 1, 7.0)], "asset string, d date, seq int, px double")
    merged = snapshots.merged(first, second)
    assert sorted((r.asset, (r.d - DAY).days, r.px) for r in merged.collect()) == [("a", 0, 6.0), ("b", 1, 7.0)]
    snapshots.save(merged, str(tmp_path / "s"))
    kept = snapshots.load(spark, str(tmp_path / "s"))
    assert sorted((r.asset, r.px) for r in kept.collect()) == [("a", 6.0), ("b", 7.0)]
    fresh = long(spark, {"a": {3: 8.0}})
    assert sorted((r.asset, r.px) for r in snapshots.with_fallback(fresh, kept).collect()) == [("a", 8.0), ("b", 7.0)]
    at = str(tmp_path / "p")
    for rows in ([("p", 1), ("p", 2), ("q", 3)], [("p", 9)]):
        snapshots.replace_portfolios(spark.createDataFrame(rows, "portfolio_id string, v int"), at)
    assert sorted((r.portfolio_id, r.v) for r in snapshots.portfolios(spark, at, "portfolio_id string, v int").collect()) == [("p", 9), ("q", 3)]
