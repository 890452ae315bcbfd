import math
from datetime import date, timedelta
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators import allocation, backtest, bonds, exposure, panel, risk
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = ["customer", "lineitem", "orders", "part"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["q_hist_var", "q_es", "q_drawdown", "q_fhs", "q_stress", "q_held_returns", "q_position_changes", "q_es_975", "q_bond_metrics", "q_srri", "q_backtest", "q_headline_var", "q_vol_regime", "q_beat_deposit", "q_fx_split", "q_liquidity", "q_shock_grid", "q_simulate", "q_lw_cov", "q_attribution", "q_real", "q_score"])
def test_query_equals_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, DATA)
    columns = sorted(mine.columns)
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert sorted(map(str, map(tuple, mine.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def _series(spark, r):
    start = date(2022, 1, 3)
    rows = [("p", start + timedelta(days=i), i, float(x)) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "portfolio_id string, d date, i int, r double")


def test_normal_distribution(spark):
    x = [-40.0, -8.0, -1.5, 0.0, 0.3, 2.0, 7.5, 40.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(norm_cdf(F.col("x"))).collect()]
    assert max(abs(a - NormalDist().cdf(v)) for a, v in zip(got, x, strict=True)) < 1e-15


def test_drawdown_closed_form(spark):
    r = risk.drawdown(_series(spark, [math.log(2), math.log(0.5)] + [0.0] * 200)).first()
    assert r.max_drawdown == pytest.approx(-0.5) and r.current_run == 201


def test_too_little_data_gives_nulls(spark):
    s = _series(spark, np.random.default_rng(1).normal(0, 0.02, 30))
    assert risk.expected_shortfall(s).first().es is None
    assert risk.evt_tail(s).first().xi is None


def test_var_recovers_normal(spark):
    s = _series(spark, np.random.default_rng(42).normal(0, 0.01, 20_000))
    assert risk.historical_var(s).first()["var"] == pytest.approx(-0.02326, rel=0.05)


def test_bonds(spark):
    rows = [(1, 0.10, 5.0, 0.10, 1, 1e5, 95.0), (2, 0.0, 3.0, 0.08, 1, 1e5, 95.0)]
    par, zero = bonds.metrics(spark.createDataFrame(rows, "bond_id long, coupon double, years double, ytm double, frequency int, nominal double, price double")).orderBy("bond_id").collect()
    assert par.fair == pytest.approx(100) and zero.macaulay == pytest.approx(3) and par.modified == pytest.approx(par.macaulay / 1.1)


def test_zero_price_gives_no_infinity(spark):
    px = {"A": [100, 101, 0, 103, 104], "B": [50, 51, 52, 53, 54]}
    rows = [(a, date(2025, 1, 1) + timedelta(days=i), float(x)) for a, v in px.items() for i, x in enumerate(v)]
    r = panel.log_returns(spark.createDataFrame(rows, "asset string, d date, px double")).collect()
    assert len(r) == 6 and all(math.isfinite(x.r) for x in r)


def _backtest(spark, n, seed):
    r = np.random.default_rng(seed).normal(0.0005, 0.02, n)
    return {x.model: x for x in backtest.backtest(risk.ewma_path(_series(spark, r))).collect()}, r


def test_backtest_counts_by_hand(spark):
    got, r = _backtest(spark, 420, 7)
    by_hand = sum(r[t] < np.quantile(r[max(0, t - 500) : t], 1 - 0.99) for t in range(420 - 250, 420))
    assert set(got) == set(backtest.MODELS) and got["historical"].days == 250 and got["historical"].violations == by_hand


def test_backtest_of_too_few_days_keeps_rows(spark):
    got, _ = _backtest(spark, 120, 7)
    assert len(got) == 3 and all(x.days is None and x.zone is None for x in got.values())


def test_headline_without_backtest_is_historical(spark):
    path = risk.ewma_path(_series(spark, np.random.default_rng(3).normal(0, 0.01, 120)))
    row = backtest.headline_var(path).first()
    assert row.model == "historical" and row["var"] is not None and row.zone is None


def test_vol_regime_needs_a_year(spark):
    r = np.random.default_rng(41).normal(0, 0.01, 600)
    whole, short = (backtest.vol_regime(risk.ewma_path(_series(spark, x))).first() for x in (r, r[:100]))
    assert 0 <= whole.percentile <= 1 and whole.observations == 570 and short.percentile is None


def test_deposit_odds(spark):
    s = _series(spark, np.random.default_rng(5).normal(math.log(1.8) / 252, 0.008, 300))
    row = exposure.beat_deposit(s, 0.4).first()
    assert row.below < 0.3 and row.below > row.below_point
    assert exposure.beat_deposit(s, None).first().below is None


def test_portfolio_of_the_currency_alone(spark):
    s = _series(spark, np.random.default_rng(3).normal(0, 0.01, 400))
    w = spark.createDataFrame([("p", "usd", 10.0, 1.0)], "portfolio_id string, asset string, value double, w double")
    row = exposure.currency_split(s, w, s.select("d", F.col("r").alias("f")), ["usd"]).first()
    assert row.exposure == 1 and row.fx_share == pytest.approx(1) and row.local_share == pytest.approx(0)


def test_liquidity_multiplier(spark):
    rows = [("p", "slow", 100_000.0, 10_000.0, "equity"), ("p", "cash", 100_000.0, None, "liquid"), ("q", "none", 0.0, None, None)]
    got = {r.asset: r for r in exposure.liquidity(spark.createDataFrame(rows, "portfolio_id string, asset string, value double, adv double, kind string")).collect()}
    assert got["slow"].days_to_exit == 40 and got["cash"].lvar_multiplier == pytest.approx(0.5 * math.sqrt(40) + 0.5)
    assert got["none"].lvar_multiplier is None


def test_shocks_without_beta_count_as_nothing(spark):
    betas = spark.createDataFrame([("p", "x", 0.8)], "portfolio_id string, factor string, beta double")
    values = spark.createDataFrame([("p", 1e6)], "portfolio_id string, value double")
    got = {r.scenario: r.impact for r in exposure.shock_grid(betas, values, [("fall", "x", -0.2), ("else", "y", -0.5)]).collect()}
    assert got["fall"] == pytest.approx(-160_000) and got["else"] == 0


def test_long_value_paths_are_thinned(spark):
    s = _series(spark, [0.0] * 700)
    got = exposure.value_path(s, spark.createDataFrame([("p", 5.0)], "portfolio_id string, value double")).orderBy("point").collect()
    assert got[0].point == 0 and got[0].d is None and got[-1].point == 700 and len(got) <= 301 and {r.value for r in got} == {5.0}


def _panel(spark, x):
    start = date(2022, 1, 3)
    rows = [(f"a{j}", start + timedelta(days=i), float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "asset string, d date, r double")


def _shrunk(x, textbook):
    x = x - x.mean(0)
    t, k = x.shape
    s, sd = x.T @ x / t, x.std(0)
    size, off = np.outer(sd, sd), ~np.eye(k, dtype=bool)
    rbar = (s / size)[off].mean()
    f = np.where(off, rbar * size, s)
    noise = (x**2).T @ x**2 / t - s**2
    theta = (x**3).T @ x / t - np.diag(s)[:, None] * s
    lean = theta * sd[None, :] / (sd[:, None] * (1 if textbook else sd[None, :] + 1e-12))
    d = min(1, max(0, (noise.sum() - np.trace(noise) - rbar * lean[off].sum()) / ((f - s) ** 2).sum() / t))
    return d, d * f + (1 - d) * s


def test_shrunk_covariance_and_attribution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (500, 1)) * 0.5 + rng.normal(0, 1, (500, 4)) * np.array([2.0, 1.0, 1.5, 0.5])
    values = [60.0, 40.0, 10.0, 30.0]
    w = spark.createDataFrame([("p", f"a{j}", v, v / 140) for j, v in enumerate(values)] + [("q", "a0", 5.0, 1.0), ("r", "new", 5.0, 1.0)], "portfolio_id string, asset string, value double, w double")
    moments = allocation.pair_moments(_panel(spark, x))
    for textbook in (False, True):
        want, c = _shrunk(x, textbook)
        rows = allocation.shrunk_covariance(moments, w, textbook).where("portfolio_id = 'p'").collect()
        assert all(r.cov == pytest.approx(c[int(r.a[1]), int(r.b[1])], abs=1e-12) and r.shrinkage == pytest.approx(want, abs=1e-9) for r in rows) and len(rows) == 16
    c = _shrunk(x, False)[1]
    got = {(r.portfolio_id, r.asset): r for r in allocation.attribution(allocation.shrunk_covariance(moments, w), w, spark.createDataFrame([("p", -0.03), ("q", -0.1)], "portfolio_id string, var double")).collect()}
    v, total = np.array(values), 140 * 0.03
    for j in range(4):
        rest = np.delete(np.arange(4), j)
        sigma = math.sqrt(v[rest] @ c[np.ix_(rest, rest)] @ v[rest] / (v @ c @ v))
        assert got["p", f"a{j}"].incremental == pytest.approx(total * (sigma - 1)) and got["p", f"a{j}"].component == pytest.approx(v[j] * (c @ v)[j] / (v @ c @ v) * total)
    assert got["q", "a0"].component is None and got["r", "new"].share is None


def test_real_returns(spark):
    s = _series(spark, np.full(900, math.log(1.45) / 365))
    months = [(date(2021 + (m + 6) // 12, (m + 6) % 12 + 1, 28), 100 * 1.035**m) for m in range(40)]
    r = allocation.real_returns(s, spark.createDataFrame(months, "d date, v double")).first()
    assert r.inflation == pytest.approx(1.035**12 - 1) and r.nominal > 0 and r.real == pytest.approx((1 + r.nominal) / (1 + r.inflation) - 1)
    assert allocation.real_returns(s, spark.createDataFrame(months[:12], "d date, v double")).first().real is None


def test_score_passes_missing_weights_on(spark):
    rows = [("a", 1.0, 2.6, 4, 1.0, "yellow", 0.0), ("b", -0.5, None, None, None, None, None), ("c", None, None, None, None, None, None)]
    parts = spark.createDataFrame(rows, "portfolio_id string, sharpe double, effective_bets double, n_assets int, tail_ratio double, zone string, prob_loss double")
    got = {r.portfolio_id: r for r in allocation.composite_score(parts).collect()}
    assert got["a"].diversification == 53.3 and got["a"].model == 50 and got["a"].drawdown is None
    assert got["a"].score == pytest.approx(round((35 * 100 + 20 * 160 / 3 + 15 * 100 + 10 * 50 + 10 * 100) / 90, 1)) and got["b"].score == 25 and got["c"].score is None
    fallen = spark.createDataFrame([("d", -0.2, -0.1, 3.0)], "portfolio_id string, max_drawdown double, expected_drawdown double, calmar double")
    assert allocation.composite_score(fallen).first().drawdown == 5


def test_stress_by_each_portfolios_own_calendar(spark):
    """A portfolio's days don't depend on what others hold; gaps on the raw calendar give no return; weights are those that trade."""
    day = lambda i: date(2020, 3, 2) + timedelta(days=i)
    px = {"x": [100, 90, 95, 80, 85], "y": [10, 11, None, 12, 9], "z": [None, None, None, 5, 6]}
    rows = [(a, day(i), float(v)) for a, p in px.items() for i, v in enumerate(p) if v]
    w = spark.createDataFrame([("p", "x", 60.0, 0.6), ("p", "old", 40.0, 0.4), ("q", "x", 30.0, 0.5), ("q", "y", 30.0, 0.5), ("r", "z", 7.0, 1.0)], "portfolio_id string, asset string, value double, w double")
    scenarios = [("crash", "2020-03-01", "2020-03-31", "A"), ("none", "1990-01-01", "1990-12-31", "B")]
    got = {(r.scenario, r.portfolio_id): r for r in exposure.stress(spark.createDataFrame(rows, "asset string, d date, px double"), w, scenarios).collect()}
    p, q, r = (got["crash", k] for k in "pqr")
    assert p.n_days == 4 and p.cumulative_return == pytest.approx(0.85 - 1) and p.impact == pytest.approx(-9) and p.missing == 40
    want = math.exp(0.5 * (math.log(0.9) + math.log(85 / 80)) + 0.5 * (math.log(1.1) + math.log(9 / 12))) - 1
    assert q.n_days == 2 and q.cumulative_return == pytest.approx(want) and r.cumulative_return == pytest.approx(0.2)
    assert got["none", "p"].cumulative_return is None and got["none", "p"].missing == 100


def test_held_returns_of_disjoint_calendars(spark):
    """A short-lived asset of one portfolio takes no day from another."""
    day = lambda i: date(2020, 3, 2) + timedelta(days=i)
    rows = [("long", day(i), 10.0 + i) for i in range(8)] + [("short", day(i), 5.0 + i) for i in (2, 5)] + [("late", day(i), 7.0) for i in (20, 21)]
    own = spark.createDataFrame([("p", "long"), ("q", "long"), ("q", "short"), ("r", "late"), ("r", "unknown")], "portfolio_id string, asset string")
    got = {}
    for r in panel.held_returns(spark.createDataFrame(rows, "asset string, d date, px double"), own).collect():
        got.setdefault((r.portfolio_id, r.asset), []).append(r.r)
    assert len(got["p", "long"]) == 7 and got["q", "long"] == [pytest.approx(math.log(15 / 12))] and got["r", "late"] == [0.0]
