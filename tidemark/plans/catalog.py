"""The registered queries of the portfolio engine and their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import allocation as A
from tidemark.operators import backtest as T
from tidemark.operators import bonds as B
from tidemark.operators import exposure as E
from tidemark.operators import panel as N
from tidemark.operators import risk as R
from tidemark.operators.book import Book
from tidemark.sources import roles as S
from tidemark.sources import tables as K

SCENARIOS = [("mid_1996", "1996-05-01", "1996-09-30", "A"), ("autumn_1998", "1998-08-01", "1998-10-31", "A"), ("spring_2000", "2000-03-01", "2000-06-30", "B"), ("before_data", "1980-01-01", "1980-12-31", "B")]

FX, DIRECT, DEPOSIT = "1-URGENT", ["A"], 0.4
SHOCKS = [("fall", "A", -0.2), ("fall", "N", -0.1), ("fall", "R", -0.1), ("rise", "A", 0.1), ("rise", "N", 0.15), ("elsewhere", "other", -0.3)]


#: Holdings of the panel with gaps: assets by portfolio.
HELD = {"ends": ["1-URGENT", "5-LOW"], "all": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "one": ["3-MEDIUM"]}


def _held(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, a) for p, own in HELD.items() for a in own], "portfolio_id string, asset string")


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _returns(spark: SparkSession, d: str) -> DataFrame:
    """set_id, asset, d, r on the calendar of each set of assets that a portfolio holds."""
    return N.set_returns(S.prices(spark, d), N.asset_sets(S.prices(spark, d), S.holdings(spark, d))[1])


def _weights(spark: SparkSession, d: str) -> DataFrame:
    prices, held = S.prices(spark, d), S.holdings(spark, d)
    return N.weights(held, prices, N.asset_sets(prices, held)[0])


def _series(spark: SparkSession, d: str) -> DataFrame:
    return N.portfolio_returns(_returns(spark, d), _weights(spark, d))


def _stress(spark: SparkSession, d: str) -> DataFrame:
    out = E.stress(S.prices(spark, d), _weights(spark, d), SCENARIOS)
    return out.select("scenario", "region", "portfolio_id", "n_days", F.round("cumulative_return", 8).alias("cumulative_return"), *[F.round(c, 2).alias(c) for c in ("impact", "missing")])


def _valuation(spark: SparkSession, d: str) -> DataFrame:
    w = _weights(spark, d).drop("set_id")
    cost = S.prices(spark, d).groupBy("asset").agg(F.min_by("px", "d").alias("cost"))
    held = S.holdings(spark, d).join(w.drop("w"), ["portfolio_id", "asset"]).join(cost, "asset")
    paid = F.col("quantity") * F.col("cost")
    return held.select("portfolio_id", "asset", "quantity", "value", paid.alias("cost_total"), (F.col("value") - paid).alias("pnl"), F.try_divide(F.col("value") - paid, paid).alias("pnl_share"))


def _adv(spark: SparkSession, d: str) -> DataFrame:
    daily = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return daily.where("v > 0").groupBy("asset").agg(F.count("*").alias("days"), F.avg("v").alias("adv")).where("days >= 10")


def _dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each day by source order, as fund prices are deduplicated."""
    e = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("px"))
    return e.groupBy("asset", "d").agg(F.max_by("px", "seq").alias("px"))


def _fx(spark: SparkSession, d: str) -> DataFrame:
    return E.log_change(N.daily_fill(S.sparse_prices(spark, d).where(F.col("asset") == FX), ["asset"]))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).groupBy("portfolio_id").agg(F.sum("value").alias("value"))


def _liquidity(spark: SparkSession, d: str) -> DataFrame:
    """Positions against the volume in money, pieces at the last price: R trades as an equity, A as a fund, the rest is liquid."""
    kind = F.when(F.col("asset") == "R", "equity").when(F.col("asset") == "A", "fund").otherwise("liquid")
    last = S.prices(spark, d).groupBy("asset").agg(F.max_by("px", "d").alias("last"))
    volume = _adv(spark, d).join(last, "asset").select("asset", (F.col("adv") * F.col("last")).alias("adv"))
    return E.liquidity(_weights(spark, d).join(volume, "asset", "left").withColumn("kind", kind))


def _shocks(spark: SparkSession, d: str) -> DataFrame:
    factors = _returns(spark, d).select(F.col("asset").alias("factor"), "d", F.col("r").alias("f"))
    return E.shock_grid(E.factor_betas(_series(spark, d), factors), _values(spark, d), SHOCKS)


def _book(spark: SparkSession, d: str) -> Book:
    """The segments' portfolios; what several figures read is written once."""
    return Book(S.prices(spark, d), S.holdings(spark, d), keep=K.written)


def _attribution(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    return A.attribution(book.covariance, book.weights, R.historical_var(book.series))


def _score(spark: SparkSession, d: str) -> DataFrame:
    """The score from figures of one written series, rounded as the other queries report them."""
    book = _book(spark, d)
    s, ask = book.series, lambda df, *columns, digits=6: _rounded(df, digits).select("portfolio_id", *columns)
    parts = ask(R.sharpe_confidence(s, 0.0001), F.col("low").alias("sharpe"))
    for more in (
        ask(R.filtered_historical(book.path), F.try_divide("es_fhs", "var_fhs").alias("tail_ratio"), digits=8), T.headline(book.models).select("portfolio_id", "zone"),
        ask(A.real_returns(s, S.price_index(spark, d)), "prob_loss"), ask(R.drawdown(s), "max_drawdown", "calmar"),
    ):
        parts = parts.join(more, "portfolio_id", "left")
    return A.composite_score(parts)


def queries() -> dict:
    series = lambda f, digits=8: lambda spark, d: _rounded(f(_series(spark, d)), digits)
    returns = lambda f, digits=8: lambda spark, d: _rounded(f(_returns(spark, d)), digits)
    return {
        "q_log_returns": returns(lambda r: r.drop("set_id")),
        "q_portfolio_returns": series(lambda s: s),
        "q_weights": lambda spark, d: _rounded(_weights(spark, d).drop("set_id"), 6),
        "q_hist_var": series(R.historical_var),
        "q_es": series(R.expected_shortfall),
        "q_diversification": lambda spark, d: _rounded(R.diversification(_returns(spark, d), _weights(spark, d), _series(spark, d)), 2),
        "q_corr": returns(lambda r: R.correlations(r).drop("set_id")),
        "q_sharpe_multi": series(R.sharpe, 6),
        "q_sharpe_ci": series(lambda s: R.sharpe_confidence(s, 0.0001), 6),
        "q_drawdown": series(R.drawdown, 6),
        "q_ewma_path": series(R.ewma_path),
        "q_fhs": series(lambda s: R.filtered_historical(R.ewma_path(s))),
        "q_backtest": series(lambda s: T.backtest(R.ewma_path(s)), 6),
        "q_headline_var": series(lambda s: T.headline_var(R.ewma_path(s)), 6),
        "q_vol_regime": series(lambda s: T.vol_regime(R.ewma_path(s)), 6),
        "q_beat_deposit": series(lambda s: E.beat_deposit(s, DEPOSIT), 6),
        "q_fx_split": lambda spark, d: _rounded(E.currency_split(_series(spark, d), _weights(spark, d), _fx(spark, d), DIRECT), 6),
        "q_liquidity": lambda spark, d: _rounded(_liquidity(spark, d), 6),
        "q_shock_grid": lambda spark, d: _rounded(_shocks(spark, d), 4),
        "q_simulate": lambda spark, d: _rounded(E.value_path(_series(spark, d), _values(spark, d)), 2),
        "q_evt": series(R.evt_tail, 6),
        "q_tail_dep": returns(lambda r: R.tail_dependence(r).drop("set_id"), 6),
        "q_srri": series(R.srri, 6),
        "q_concentration_hhi": lambda spark, d: _rounded(R.concentration(_weights(spark, d))),
        "q_beta_1f": lambda spark, d: _rounded(R.beta((r := _returns(spark, d)), r.groupBy("set_id", "d").agg(F.avg("r").alias("f"))).drop("set_id"), 6),
        "q_lw_cov": lambda spark, d: _rounded(_book(spark, d).covariance.select("portfolio_id", "a", "b", "shrinkage", (F.col("cov") * 1e4).alias("cov"))),
        "q_attribution": lambda spark, d: _rounded(_attribution(spark, d), 4),
        "q_real": lambda spark, d: _rounded(A.real_returns(_series(spark, d), S.price_index(spark, d)), 6),
        "q_score": _score,
        "q_held_returns": lambda spark, d: _rounded(N.held_returns(S.sparse_prices(spark, d), _held(spark))),
        "q_position_changes": lambda spark, d: _rounded(N.position_changes(S.sparse_prices(spark, d)), 6),
        "q_es_975": series(lambda s: R.expected_shortfall(s, 0.975)),
        "q_stress": _stress,
        "q_valuation": lambda spark, d: _rounded(_valuation(spark, d), 4),
        "q_bond_metrics": lambda spark, d: _rounded(B.metrics(S.bonds(spark, d)).select("bond_id", "fair", "macaulay", "modified", "value", "dv01"), 6),
        "q_bond_summary": lambda spark, d: _rounded(B.summary(B.metrics(S.bonds(spark, d))), 4),
        "q_daily_fill": lambda spark, d: _rounded(N.daily_fill(S.sparse_prices(spark, d), ["asset"]), 4),
        "q_adv": lambda spark, d: _rounded(_adv(spark, d), 6),
        "q_dedupe": lambda spark, d: _rounded(_dedupe(spark, d), 2),
    }


BASE = """
WITH RECURSIVE daily AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS d, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS e, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2),
prices AS (SELECT asset, d, CAST(sum(e) OVER w AS DOUBLE) / CAST(sum(v) OVER w AS DOUBLE) AS px FROM daily WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
good AS (SELECT * FROM prices WHERE px > 0),
full_days AS (SELECT d FROM good GROUP BY d HAVING count(*) = (SELECT count(DISTINCT asset) FROM good)),
returns AS (SELECT * FROM (SELECT asset, d, ln(px / lag(px) OVER (PARTITION BY asset ORDER BY d)) AS r FROM good WHERE d IN (SELECT d FROM full_days)) WHERE r IS NOT NULL),
last_px AS (SELECT asset, max_by(px, d) AS last, min_by(px, d) AS first FROM prices GROUP BY asset),
holdings AS (SELECT c_mktsegment AS portfolio_id, l_returnflag AS asset, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
weights AS (SELECT portfolio_id, asset, quantity * last AS value, quantity * last / sum(quantity * last) OVER (PARTITION BY portfolio_id) AS w FROM holdings JOIN last_px USING (asset)),
series AS (SELECT portfolio_id, d, r, row_number() OVER (PARTITION BY portfolio_id ORDER BY d) - 1 AS i FROM (SELECT portfolio_id, d, sum(w * r) AS r FROM returns JOIN weights USING (asset) GROUP BY 1, 2)),
hv AS (SELECT portfolio_id, count(r) AS n, quantile_cont(r, 0.010000000000000009) AS var FROM series GROUP BY 1)
"""

EWMA = """,
seed AS (SELECT portfolio_id, CASE WHEN var_pop(r) = 0 THEN 1e-8 ELSE var_pop(r) END AS v FROM series WHERE i < 30 GROUP BY 1),
path AS (SELECT portfolio_id, i, r, v FROM series JOIN seed USING (portfolio_id) WHERE i = 0
         UNION ALL SELECT s.portfolio_id, s.i, s.r, 0.94 * p.v + 0.06 * p.r * p.r FROM path p JOIN series s ON s.portfolio_id = p.portfolio_id AND s.i = p.i + 1),
ewma AS (SELECT portfolio_id, i, r, sqrt(v) AS sigma FROM path)
"""

BONDS = """
WITH b AS (SELECT p_partkey AS bond_id, p_size / 100.0::DOUBLE AS coupon, (1 + p_size % 10)::DOUBLE AS years, 0.05::DOUBLE + (p_partkey % 20) / 100.0::DOUBLE AS ytm, [1, 2, 4][(p_partkey % 3 + 1)::INTEGER] AS f, p_retailprice::DOUBLE * 100 AS nominal, 95.0::DOUBLE AS price FROM part),
flows AS (SELECT *, unnest(range(1, greatest(1, CAST(years * f AS INTEGER)) + 1)) AS k FROM b),
pv AS (SELECT *, (100.0::DOUBLE * coupon / f + CASE WHEN k = greatest(1, CAST(years * f AS INTEGER)) THEN 100 ELSE 0 END) * pow(1 + ytm / f, -k) AS x FROM flows),
m AS (SELECT bond_id, sum(x) AS fair, sum(x * k / f) / sum(x) AS macaulay, sum(x * k / f) / sum(x) / (1 + max(ytm / f)) AS modified, max(nominal * price / 100) AS value FROM pv GROUP BY bond_id)
"""


def _stress_sql() -> str:
    rows = ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{r}')" for n, a, b, r in SCENARIOS)
    return BASE.rstrip() + f""",
scen(scenario, a, b, region) AS (VALUES {rows}),
inside AS (SELECT scenario, asset, d, px, dense_rank() OVER (PARTITION BY scenario ORDER BY d) AS k FROM prices JOIN scen ON d BETWEEN a AND b),
moved AS (SELECT * FROM (SELECT scenario, asset, d, k, ln(px / lag(px) OVER o) AS r, lag(k) OVER o AS k0 FROM inside WHERE px > 0 WINDOW o AS (PARTITION BY scenario, asset ORDER BY d)) WHERE k0 = k - 1),
active AS (SELECT scenario, portfolio_id, asset, value / sum(value) OVER p AS share, sum(value) OVER p AS held, count(*) OVER p AS n FROM (SELECT DISTINCT scenario, asset FROM inside WHERE px > 0) JOIN weights USING (asset) WINDOW p AS (PARTITION BY scenario, portfolio_id)),
days AS (SELECT scenario, portfolio_id, d, max(held) AS held, sum(share * r) AS r FROM moved JOIN active USING (scenario, asset) GROUP BY scenario, portfolio_id, d HAVING count(*) = max(n)),
cum AS (SELECT scenario, portfolio_id, count(*) AS n_days, max(held) AS held, exp(sum(r)) - 1 AS c FROM days GROUP BY scenario, portfolio_id),
total AS (SELECT portfolio_id, sum(value) AS value FROM weights GROUP BY portfolio_id)
SELECT scenario, region, portfolio_id, coalesce(n_days, 0)::BIGINT AS n_days, round(c, 8) AS cumulative_return, round(held * c, 2) AS impact, round(value - coalesce(held, 0), 2) AS missing
FROM scen CROSS JOIN total LEFT JOIN cum USING (scenario, portfolio_id)
"""


def oracle_sql() -> dict[str, str]:
    n = lambda w: f"count(CASE WHEN back <= {w} THEN 1 END) AS n_{w}"
    s = lambda w, least: f"CASE WHEN count(CASE WHEN back <= {w} THEN 1 END) >= {least} THEN round(avg(CASE WHEN back <= {w} THEN r END) * 252 / (stddev_samp(CASE WHEN back <= {w} THEN r END) * sqrt(252)), 6) END AS sharpe_{w}"
    back = "(SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY i DESC) AS back FROM series)"
    cdf = "CASE WHEN z > 0 THEN 1 - t ELSE t END"
    tail = "exp(-z * z / 2) * ((((((3.52624965998911e-02 * y + 0.700383064443688) * y + 6.37396220353165) * y + 33.912866078383) * y + 112.079291497871) * y + 221.213596169931) * y + 220.206867912376) / (((((((8.83883476483184e-02 * y + 1.75566716318264) * y + 16.064177579207) * y + 86.7807322029461) * y + 296.564248779674) * y + 637.333633378831) * y + 793.826512519948) * y + 440.413735824752)"
    p, zq = "0.010000000000000009", NormalDist().inv_cdf(1 - 0.99)
    ll = lambda prob, k, m: f"({m} * ln(greatest(1 - {prob}, 1e-12)) + {k} * ln(greatest({prob}, 1e-12)))"
    chi = lambda lr: f"(SELECT CASE WHEN lr > 0 THEN 2 * t ELSE 1.0 END FROM (SELECT lr, {tail} AS t FROM (SELECT {lr} AS lr, sqrt(greatest({lr}, 0)) AS z, sqrt(greatest({lr}, 0)) AS y)))"
    phi = lambda z: f"(SELECT {cdf} FROM (SELECT z, {tail} AS t FROM (SELECT {z} AS z, abs({z}) AS y)))"
    tests = f""", wide AS (SELECT portfolio_id, i, count(*) OVER (PARTITION BY portfolio_id) AS n, r, quantile_cont(r, {p}) OVER b AS historical, {zq} * sigma AS ewma,
    quantile_cont(CASE WHEN i >= 30 THEN r / sigma END, {p}) OVER b * sigma AS fhs FROM ewma WINDOW b AS (PARTITION BY portfolio_id ORDER BY i ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)),
tested AS (SELECT * FROM wide WHERE least(250, n - 150) >= 75 AND i >= n - least(250, n - 150)),
hits AS (SELECT portfolio_id, i, 'historical' AS model, (r < historical)::INT AS hit FROM tested UNION ALL SELECT portfolio_id, i, 'ewma', (r < ewma)::INT FROM tested UNION ALL SELECT portfolio_id, i, 'fhs', (r < fhs)::INT FROM tested),
moved AS (SELECT *, lag(hit) OVER (PARTITION BY portfolio_id, model ORDER BY i) AS was FROM hits),
s AS (SELECT portfolio_id, model, count(*) AS n, sum(hit)::BIGINT AS x, count(*) FILTER (was = 0 AND hit = 0) AS n00, count(*) FILTER (was = 0 AND hit = 1) AS n01, count(*) FILTER (was = 1 AND hit = 0) AS n10, count(*) FILTER (was = 1 AND hit = 1) AS n11 FROM moved GROUP BY 1, 2),
l AS (SELECT *, -2 * ({ll(p, "x", "(n - x)")} - {ll("(x / n)", "x", "(n - x)")}) AS uc,
    -2 * ({ll("((n01 + n11) / (n - 1))", "(n01 + n11)", "(n00 + n10)")} - {ll("(n01 / nullif(n00 + n01, 0))", "n01", "n00")} - {ll("(n11 / nullif(n10 + n11, 0))", "n11", "n10")}) AS ind FROM s),
scored AS (SELECT portfolio_id, model, n AS days, x AS violations, round(CAST(n * {p} AS DOUBLE), 6) AS expected, round({chi("uc")}, 6) AS kupiec_p, CASE WHEN x >= 2 AND n00 + n01 > 0 AND n10 + n11 > 0 THEN round({chi("ind")}, 6) END AS christoffersen_p,
    CASE WHEN x * 250 / n <= 4 THEN 'green' WHEN x * 250 / n <= 9 THEN 'yellow' ELSE 'red' END AS zone FROM l),
tests AS (SELECT portfolio_id, model, days, violations, expected, kupiec_p, christoffersen_p, zone FROM (SELECT DISTINCT portfolio_id, unnest(['historical', 'ewma', 'fhs']) AS model FROM series) LEFT JOIN scored USING (portfolio_id, model)),
today AS (SELECT portfolio_id, count(*) AS n, sqrt(0.94 * pow(max_by(sigma, i), 2) + 0.06 * pow(max_by(r, i), 2)) AS t FROM ewma GROUP BY 1)"""
    fx = f""", fxp AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS px FROM orders WHERE o_orderpriority = '{FX}' GROUP BY 1),
fxd AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM fxp), fxf AS (SELECT d, last_value(px IGNORE NULLS) OVER (ORDER BY d) AS px FROM fxd LEFT JOIN fxp USING (d)), fx AS (SELECT d, ln(px / lag(px) OVER (ORDER BY d)) AS f FROM fxf),
e AS (SELECT portfolio_id, least(1.0, coalesce(sum(CASE WHEN asset IN ('{"', '".join(DIRECT)}') THEN w END), 0.0)) AS e FROM weights GROUP BY 1),
v AS (SELECT portfolio_id, e, count(*) AS n, var_samp(r) AS vp, var_samp(r - e * f) AS vl, var_samp(e * f) AS vf, var_samp(f) AS vx, avg(f) AS m FROM series JOIN fx USING (d) JOIN e USING (portfolio_id) WHERE f IS NOT NULL GROUP BY 1, 2)"""
    totals = ", totals AS (SELECT portfolio_id, sum(value) AS value FROM weights GROUP BY 1)"
    shocks = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in SHOCKS)
    cov = """, x AS (SELECT asset, d, r - avg(r) OVER (PARTITION BY asset) AS x FROM returns),
mo AS (SELECT p.asset AS a, q.asset AS b, count(*) AS n, avg(p.x * q.x) AS s, avg(p.x * p.x * q.x * q.x) AS q, avg(p.x * p.x * p.x * q.x) AS c FROM x p JOIN x q USING (d) GROUP BY 1, 2),
own AS (SELECT w.portfolio_id, m.*, sqrt(va.s) AS sa, sqrt(vb.s) AS sb FROM mo m JOIN weights w ON w.asset = m.a JOIN weights u ON u.asset = m.b AND u.portfolio_id = w.portfolio_id JOIN mo va ON va.a = m.a AND va.b = m.a JOIN mo vb ON vb.a = m.b AND vb.b = m.b),
su AS (SELECT portfolio_id, avg(CASE WHEN a <> b THEN s / (sa * sb) END) AS rbar, sum(q - s * s) AS pi, sum(CASE WHEN a = b THEN q - s * s END) AS rho, sum(CASE WHEN a <> b THEN (c - sa * sa * s) * sb / (sa * (sb + 1e-12)) END) AS lean FROM own GROUP BY 1),
ta AS (SELECT *, CASE WHEN a <> b THEN rbar * sa * sb ELSE s END AS t FROM own JOIN su USING (portfolio_id)),
de AS (SELECT portfolio_id, greatest(0.0, least(1.0, (max(pi) - max(rho) - max(rbar) * max(lean)) / sum((t - s) * (t - s)) / max(n))) AS delta FROM ta GROUP BY 1),
cov AS (SELECT portfolio_id, a, b, delta, s + delta * (t - s) AS cov FROM ta JOIN de USING (portfolio_id))"""
    cpi = """, cpi AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1), cb AS (SELECT *, row_number() OVER (ORDER BY d DESC) AS k FROM cpi),
y AS (SELECT max(CASE WHEN k = 13 THEN d END) AS a, max(CASE WHEN k = 1 THEN d END) AS b, max(CASE WHEN k = 1 THEN v END) / max(CASE WHEN k = 13 THEN v END) - 1 AS inf FROM cb),
rb AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY i DESC) AS back FROM series CROSS JOIN y),
rm AS (SELECT portfolio_id, inf, count(*) AS n, count(*) FILTER (d > a AND d <= b) AS k, sum(r) FILTER (d > a AND d <= b) AS w, sum(r) FILTER (back <= 252) AS l, avg(r) FILTER (back <= 504) * 252 AS mu, stddev_samp(r) FILTER (back <= 504) * sqrt(252) AS sg FROM rb GROUP BY 1, 2),
rn AS (SELECT *, exp(CASE WHEN k >= 60 THEN w ELSE l END) - 1 AS nom, (ln(1 + inf) - mu) / sg AS zz FROM rm WHERE n >= 120)"""
    out = {
        "q_lw_cov": BASE + cov + " SELECT portfolio_id, a, b, round(delta, 8) AS shrinkage, round(cov * 10000, 8) AS cov FROM cov",
        "q_attribution": BASE + cov + """, ro AS (SELECT portfolio_id, a AS asset, sum(cov * value) AS m, sum(CASE WHEN a = b THEN cov END) AS c FROM cov JOIN weights w USING (portfolio_id) WHERE w.asset = b GROUP BY 1, 2),
ea AS (SELECT portfolio_id, asset, value, w, m, c, abs(var) * sum(value) OVER p AS money, sum(value * m) OVER p AS v FROM weights JOIN ro USING (portfolio_id, asset) JOIN hv USING (portfolio_id) WINDOW p AS (PARTITION BY portfolio_id))
SELECT portfolio_id, asset, round(w, 4) AS weight, round(value * m / v * money, 4) AS component, round(value * m / v, 4) AS share, round(money * (sqrt(greatest(0.0, v - 2 * value * m + value * value * c) / v) - 1), 4) AS incremental FROM ea""",
        "q_real": BASE + cpi + f" SELECT portfolio_id, n, round(inf, 6) AS inflation, round(nom, 6) AS nominal, round((1 + nom) / (1 + inf) - 1, 6) AS \"real\", round({phi('zz')}, 6) AS prob_loss, k >= 60 AS aligned FROM rn",
        "q_backtest": BASE + EWMA + tests + " SELECT * FROM tests",
        "q_headline_var": BASE + EWMA + tests + f""", best AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY CASE zone WHEN 'green' THEN 2 WHEN 'yellow' THEN 1 WHEN 'red' THEN 0 ELSE -1 END DESC, kupiec_p DESC NULLS LAST, list_position(['historical', 'ewma', 'fhs'], model)) AS k FROM tests),
zz AS (SELECT portfolio_id, quantile_cont(r / sigma, {p}) AS q FROM ewma WHERE i >= 30 GROUP BY 1)
SELECT portfolio_id, model, round(CASE model WHEN 'fhs' THEN q * t WHEN 'ewma' THEN {zq} * t ELSE var END, 6) AS var, zone, kupiec_p FROM best JOIN hv USING (portfolio_id) JOIN today USING (portfolio_id) JOIN zz USING (portfolio_id) WHERE k = 1""",
        "q_vol_regime": BASE + EWMA + tests + """ SELECT portfolio_id, count(*) AS observations, round(max(t) * sqrt(252), 6) AS current_vol, round(avg((sigma <= t)::INT), 6) AS percentile, round(quantile_cont(sigma, 0.5) * sqrt(252), 6) AS median_vol
FROM ewma JOIN today USING (portfolio_id) WHERE i >= 30 GROUP BY 1""",
        "q_beat_deposit": BASE + f""", m AS (SELECT portfolio_id, count(r) AS n, avg(r - ln(1 + {DEPOSIT}) / 252) / stddev_pop(r) AS sr FROM series GROUP BY 1), zs AS (SELECT *, -sr * sqrt(252) AS z0, -sr * sqrt(252) / sqrt(1 + (1 + 0.5 * sr * sr) / n * 252) AS z1 FROM m)
SELECT portfolio_id, n, round({phi("z1")}, 6) AS below, round({phi("z0")}, 6) AS below_point FROM zs""",
        "q_fx_split": BASE + fx + " SELECT portfolio_id, round(e, 6) AS exposure, round(vl / vp, 6) AS local_share, round(vf / vp, 6) AS fx_share, round((vp - vl - vf) / vp, 6) AS cov_share, round(sqrt(vx * 252), 6) AS fx_vol, round(m * 252, 6) AS fx_drift FROM v WHERE n >= 120",
        "q_liquidity": BASE + """, adv AS (SELECT asset, avg(v) AS adv FROM daily WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10),
t AS (SELECT portfolio_id, asset, w, CASE asset WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN greatest(1.0::DOUBLE, coalesce(value / (0.25::DOUBLE * adv * last), 1.0)) ELSE 1.0 END AS t FROM weights LEFT JOIN adv USING (asset) JOIN last_px USING (asset))
SELECT portfolio_id, asset, round_even(t, 1) AS days_to_exit, round(w, 6) AS value_share, round(sum(w * sqrt(t)) OVER (PARTITION BY portfolio_id), 6) AS lvar_multiplier FROM t""",
        "q_shock_grid": BASE + totals + f""", betas AS (SELECT s.portfolio_id, x.asset AS factor, regr_slope(s.r, x.r) AS beta FROM series s JOIN returns x USING (d) GROUP BY 1, 2), shocks(scenario, factor, shock) AS (VALUES {shocks}),
c AS (SELECT portfolio_id, scenario, value, sum(coalesce(beta, 0) * shock) AS change FROM totals CROSS JOIN shocks LEFT JOIN betas USING (portfolio_id, factor) GROUP BY 1, 2, 3) SELECT portfolio_id, scenario, round(change, 4) AS change, round(change * value, 4) AS impact FROM c""",
        "q_simulate": BASE + totals + """, whole AS (SELECT portfolio_id, 0::BIGINT AS point, NULL::DATE AS d, value FROM totals UNION ALL SELECT portfolio_id, i + 1, d, value * exp(sum(r) OVER (PARTITION BY portfolio_id ORDER BY i)) FROM series JOIN totals USING (portfolio_id)),
c AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS n FROM whole)
SELECT portfolio_id, point, d, round(value, 2) AS value FROM c WHERE point % (CASE WHEN n > 300 THEN n // 300 + 1 ELSE 1 END) = 0 OR point = n - 1""",
        "q_log_returns": BASE + "SELECT asset, d, round(r, 8) AS r FROM returns",
        "q_portfolio_returns": BASE + "SELECT portfolio_id, d, round(r, 8) AS r, i FROM series",
        "q_weights": BASE + "SELECT portfolio_id, asset, round(value, 6) AS value, round(w, 6) AS w FROM weights",
        "q_hist_var": BASE + "SELECT portfolio_id, n, round(var, 8) AS var FROM hv",
        "q_es": BASE + "SELECT portfolio_id, n, CASE WHEN n >= 60 THEN round(var, 8) END AS var, CASE WHEN n >= 60 THEN round(avg(CASE WHEN r <= var THEN r END), 8) END AS es FROM series JOIN hv USING (portfolio_id) GROUP BY portfolio_id, n, var",
        "q_diversification": BASE + ", own AS (SELECT asset, quantile_cont(r, 0.010000000000000009) AS av FROM returns GROUP BY asset), a AS (SELECT portfolio_id, sum(value * av) AS sv, sum(value) AS t FROM weights JOIN own USING (asset) GROUP BY 1) SELECT portfolio_id, round(sv, 2) AS sum_var, round(var * t, 2) AS portfolio_var, round(abs(sv) - abs(var * t), 2) AS benefit FROM a JOIN hv USING (portfolio_id)",
        "q_corr": BASE + "SELECT x.asset AS a, y.asset AS b, count(*) AS n, round(corr(x.r, y.r), 8) AS rho, round(covar_samp(x.r, y.r), 8) AS cov FROM returns x JOIN returns y ON x.d = y.d AND x.asset < y.asset GROUP BY 1, 2",
        "q_sharpe_multi": BASE + f"SELECT portfolio_id, {n(252)}, {s(252, 60)}, {n(756)}, {s(756, 453)}, {n(1260)}, {s(1260, 756)} FROM {back} GROUP BY 1",
        "q_sharpe_ci": BASE + f""", x AS (SELECT portfolio_id, r - 0.0001 AS r FROM {back} WHERE back <= 252),
m AS (SELECT portfolio_id, count(*) AS n, avg(r) AS mu, stddev_pop(r) AS sd FROM x GROUP BY 1),
g AS (SELECT portfolio_id, n, mu / sd AS sr, avg(pow((r - mu) / sd, 3)) AS g3, avg(pow((r - mu) / sd, 4)) AS g4 FROM x JOIN m USING (portfolio_id) GROUP BY portfolio_id, n, mu, sd),
zs AS (SELECT *, sqrt((1 + 0.5 * sr * sr) / n) AS se, sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z FROM g), ys AS (SELECT *, abs(z) AS y FROM zs), ts AS (SELECT *, {tail} AS t FROM ys)
SELECT portfolio_id, n, round(sr * sqrt(252), 6) AS sharpe, round((sr - 1.96 * se) * sqrt(252), 6) AS low, round((sr + 1.96 * se) * sqrt(252), 6) AS high, round({cdf}, 6) AS psr FROM ts""",
        "q_drawdown": BASE + """, c AS (SELECT portfolio_id, i, r, exp(sum(r) OVER p) AS c FROM series WINDOW p AS (PARTITION BY portfolio_id ORDER BY i)),
dd AS (SELECT *, c / max(c) OVER (PARTITION BY portfolio_id ORDER BY i) - 1 AS dd FROM c),
runs AS (SELECT portfolio_id, g, count(CASE WHEN dd < 0 THEN 1 END) AS run FROM (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY i) AS g FROM dd) GROUP BY 1, 2),
l AS (SELECT portfolio_id, max(run) AS longest, max_by(run, g) AS now FROM runs GROUP BY 1), s AS (SELECT portfolio_id, count(*) AS n, min(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, exp(avg(r) * 252) - 1 AS annual FROM dd GROUP BY 1)
SELECT portfolio_id, n, round(mdd, 6) AS max_drawdown, round(ulcer, 6) AS ulcer, round(annual / abs(mdd), 6) AS calmar, longest AS longest_run, now AS current_run FROM s JOIN l USING (portfolio_id)""",
        "q_ewma_path": BASE + EWMA + "SELECT portfolio_id, i, round(r, 8) AS r, round(sigma, 8) AS sigma FROM ewma",
        "q_fhs": BASE + EWMA + """, today AS (SELECT portfolio_id, count(*) AS n, sqrt(0.94 * pow(max_by(sigma, i), 2) + 0.06 * pow(max_by(r, i), 2)) AS t FROM ewma GROUP BY 1),
z AS (SELECT portfolio_id, r / sigma AS z FROM ewma WHERE i >= 30), q AS (SELECT portfolio_id, quantile_cont(z, 0.010000000000000009) AS q FROM z GROUP BY 1), e AS (SELECT portfolio_id, q, avg(CASE WHEN z <= q THEN z END) AS m FROM z JOIN q USING (portfolio_id) GROUP BY 1, 2)
SELECT portfolio_id, n, round(t, 8) AS sigma_today, round(q * t, 8) AS var_fhs, round(m * t, 8) AS es_fhs FROM today JOIN e USING (portfolio_id)""",
        "q_evt": BASE + """, u AS (SELECT portfolio_id, count(*) AS n, quantile_cont(-r, 0.95) AS u FROM series GROUP BY 1),
o AS (SELECT portfolio_id, n, u, -r - u AS y FROM series JOIN u USING (portfolio_id) WHERE -r > u), j AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY y) AS j, count(*) OVER (PARTITION BY portfolio_id) AS k FROM o),
a AS (SELECT portfolio_id, n, u, k, avg(y) AS a0, avg((1 - (j - 0.35) / k) * y) AS a1 FROM j GROUP BY 1, 2, 3, 4), x AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS beta FROM a WHERE n >= 500 AND k >= 30 AND a0 - 2 * a1 > 0),
v AS (SELECT *, u + beta / xi * (pow(n / k * (1 - 0.995), -xi) - 1) AS v FROM x WHERE xi < 0.95 AND beta > 0)
SELECT portfolio_id, round(xi, 6) AS xi, round(beta, 6) AS beta, round(-v, 6) AS var_evt, round(-(v + beta - xi * u) / (1 - xi), 6) AS es_evt, round(u, 6) AS threshold, k AS exceedances FROM (SELECT DISTINCT portfolio_id FROM series) LEFT JOIN v USING (portfolio_id)""",
        "q_tail_dep": BASE + """, cut AS (SELECT asset, quantile_cont(r, 0.05) AS cut, count(*) AS n FROM returns GROUP BY 1), low AS (SELECT asset, d, n FROM returns JOIN cut USING (asset) WHERE r <= cut)
SELECT x.asset AS a, y.asset AS b, count(*) AS "both", round(count(*) / (0.05 * max(x.n)), 6) AS tail_lambda FROM low x JOIN low y ON x.d = y.d AND x.asset < y.asset GROUP BY 1, 2""",
        "q_srri": BASE + """, w AS (SELECT portfolio_id, CAST(date_trunc('week', d) AS DATE) AS wk, sum(r) AS r FROM series GROUP BY 1, 2),
g AS (SELECT portfolio_id, CAST(unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS DATE) AS wk FROM w GROUP BY 1),
b AS (SELECT portfolio_id, wk, coalesce(r, 0) AS r, row_number() OVER (PARTITION BY portfolio_id ORDER BY wk DESC) AS k FROM g LEFT JOIN w USING (portfolio_id, wk)), v AS (SELECT portfolio_id, count(*) AS weeks, stddev_samp(r) * sqrt(52) AS vol FROM b WHERE k <= 260 GROUP BY 1), vn AS (SELECT portfolio_id, weeks, CASE WHEN weeks >= 24 AND n >= 120 THEN vol END AS vol FROM v JOIN hv USING (portfolio_id))
SELECT portfolio_id, weeks, round(vol, 6) AS volatility, CAST(1 + (vol >= 0.005)::INT + (vol >= 0.02)::INT + (vol >= 0.05)::INT + (vol >= 0.1)::INT + (vol >= 0.15)::INT + (vol >= 0.25)::INT AS BIGINT) AS srri FROM vn""",
        "q_concentration_hhi": BASE + "SELECT portfolio_id, round(sum(w * w), 8) AS hhi, round(1 / sum(w * w), 8) AS effective_positions FROM weights GROUP BY 1",
        "q_beta_1f": BASE + ", f AS (SELECT d, avg(r) AS f FROM returns GROUP BY 1) SELECT asset, count(*) AS n, round(regr_slope(r, f), 6) AS beta, round(regr_r2(r, f), 6) AS r2 FROM returns JOIN f USING (d) GROUP BY 1",
        "q_held_returns": f"""
WITH px AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS px FROM orders GROUP BY 1, 2),
own(portfolio_id, asset) AS (VALUES {", ".join(f"('{p}', '{a}')" for p, own in HELD.items() for a in own)}),
held AS (SELECT portfolio_id, asset, d, px FROM px JOIN own USING (asset) WHERE px > 0),
days AS (SELECT portfolio_id, d FROM held h GROUP BY portfolio_id, d HAVING count(*) = (SELECT count(DISTINCT asset) FROM held x WHERE x.portfolio_id = h.portfolio_id))
SELECT portfolio_id, asset, d, round(r, 8) AS r FROM (SELECT portfolio_id, asset, d, ln(px / lag(px) OVER (PARTITION BY portfolio_id, asset ORDER BY d)) AS r FROM held JOIN days USING (portfolio_id, d)) WHERE r IS NOT NULL""",
        "q_position_changes": """
WITH px AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS px FROM orders GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS back FROM px WHERE px > 0),
ends AS (SELECT asset, max(d) AS d, max(CASE WHEN back = 1 THEN px END) AS last, max(CASE WHEN back = 2 THEN px END) AS before FROM ranked GROUP BY asset)
SELECT asset, round(last, 6) AS last, round(last / before - 1, 6) AS previous_change, round(last / (SELECT max_by(px, p.d) FROM px p WHERE p.asset = e.asset AND p.d <= e.d - 7) - 1, 6) AS period_change FROM ends e""",
        "q_es_975": BASE + ", cut AS (SELECT portfolio_id, count(r) AS n, quantile_cont(r, 1 - 0.975::DOUBLE) AS var FROM series GROUP BY 1) SELECT portfolio_id, n, CASE WHEN n >= 60 THEN round(var, 8) END AS var, CASE WHEN n >= 60 THEN round(avg(CASE WHEN r <= var THEN r END), 8) END AS es FROM series JOIN cut USING (portfolio_id) GROUP BY portfolio_id, n, var",
        "q_stress": _stress_sql(),
        "q_valuation": BASE + "SELECT portfolio_id, asset, round(quantity, 4) AS quantity, round(value, 4) AS value, round(quantity * first, 4) AS cost_total, round(value - quantity * first, 4) AS pnl, round((value - quantity * first) / (quantity * first), 4) AS pnl_share FROM holdings JOIN weights USING (portfolio_id, asset) JOIN last_px USING (asset)",
        "q_bond_metrics": BONDS + "SELECT bond_id, round(fair, 6) AS fair, round(macaulay, 6) AS macaulay, round(modified, 6) AS modified, round(value, 6) AS value, round(modified * value * 1e-4, 6) AS dv01 FROM m",
        "q_bond_summary": BONDS + ", t AS (SELECT sum(value) AS v, sum(modified * value) / sum(value) AS du FROM m) SELECT round(v, 4) AS value, round(du, 4) AS duration, bp::BIGINT AS shock_bp, round(-du * v * bp / 10000.0, 4) AS impact FROM t, (SELECT unnest([-100, 100, 300, 500]) AS bp)",
        "q_daily_fill": """WITH p AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS px FROM orders GROUP BY 1, 2),
g AS (SELECT asset, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM p GROUP BY 1)
SELECT asset, d, round(last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d), 4) AS px FROM g LEFT JOIN p USING (asset, d)""",
        "q_adv": "SELECT asset, count(*) AS days, round(avg(v), 6) AS adv FROM (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS d, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2) WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10",
        "q_dedupe": "SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, round(max_by(CAST(o_totalprice AS DOUBLE), o_orderkey), 2) AS px FROM orders GROUP BY 1, 2",
    }
    part = lambda x: f"greatest(0.0, least(100.0, {x}))"
    out["q_score"] = f"""WITH c AS (SELECT portfolio_id, {part('50 + 50 * low')} AS sharpe, CAST(NULL AS DOUBLE) AS diversification, {part('(1.8 - es_fhs / var_fhs) / 0.8 * 100')} AS tail,
CAST(CASE zone WHEN 'green' THEN 100 WHEN 'yellow' THEN 50 WHEN 'red' THEN 0 END AS DOUBLE) AS model, {part('(0.6 - prob_loss) / 0.6 * 100')} AS "real", {part('calmar / 2 * 100')} AS drawdown
FROM ({out["q_sharpe_ci"]}) JOIN ({out["q_fhs"]}) USING (portfolio_id) JOIN ({out["q_headline_var"]}) USING (portfolio_id) JOIN ({out["q_real"]}) USING (portfolio_id) JOIN ({out["q_drawdown"]}) USING (portfolio_id))
SELECT portfolio_id, round(sharpe, 1) AS sharpe, diversification, round(tail, 1) AS tail, round(model, 1) AS model, round("real", 1) AS "real", round(drawdown, 1) AS drawdown,
round((35 * sharpe + 15 * tail + 10 * model + 10 * "real" + 10 * drawdown) / 80, 1) AS score FROM c"""
    return out
