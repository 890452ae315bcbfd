"""Registered queries of what an overview shows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import exposure as E
from tidemark.operators import overview as O
from tidemark.plans import analysis as P
from tidemark.plans import catalog as C
from tidemark.plans import extended as T
from tidemark.sources import roles as S


def _board(spark: SparkSession, d: str) -> DataFrame:
    """The books at what their assets cost on the panel's first day; the fund's cost isn't known."""
    own = P._lazy(spark, d)
    first = own.prices.groupBy("asset").agg(F.min_by("px", "d").alias("first"))
    cost = F.when(F.col("asset") != P.FUND, F.col("quantity") * F.col("first"))
    held = own.weights.select("portfolio_id", "asset", "value").join(S.gap_holdings(spark, d), ["portfolio_id", "asset"]).join(first, "asset").withColumn("cost", cost)
    return O.board(held, E.stress(own.prices, own.weights, P._quarters(spark, d))).withColumn("value", F.round("value", 2))


def queries() -> dict:
    of = lambda f, name, own: lambda spark, d: C._rounded(f(own.queries()[name](spark, d)), 6)
    return {
        "q_board": lambda spark, d: C._rounded(_board(spark, d), 5),
        "q_style_shown": of(O.shown_styles, "q_style", T),
        "q_parity_shown": of(O.shown_parity, "q_hrp", T),
        "q_sharpe_shown": of(O.shown_sharpe, "q_sharpe_choice", P),
        "q_price_scale": lambda spark, d: C._rounded(O.line_scale(S.gap_prices(spark, d), "asset", "px"), 4),
    }


def oracle_sql() -> dict[str, str]:
    own, more = P.oracle_sql(), T.oracle_sql()
    place = lambda key, by, label: f"row_number() OVER (PARTITION BY {key} ORDER BY {by}, {label})::INTEGER AS place"
    bar = lambda key, value: f"abs({value}) / greatest(max(abs({value})) OVER (PARTITION BY {key}), 1e-9)"
    stressed = own["q_scenarios"].rsplit(" SELECT scenario, region, portfolio_id, n_days", 1)[0]
    panel = lambda name, rows, by: f"SELECT portfolio_id, '{name}' AS panel, {place('portfolio_id', by, 'label')}, label, round(value, 2) AS value, round({bar('portfolio_id', 'value')}, 5) AS bar, round(note, 5) AS note FROM ({rows}) WHERE value IS NOT NULL"
    down, up = "round(value, 2) DESC", "round(value, 2)"
    board = [
        panel("allocation", "SELECT portfolio_id, asset AS label, value, w AS note FROM weights", down),
        panel("gains", f"SELECT portfolio_id, asset AS label, value - quantity * first AS value, (value - quantity * first) / (quantity * first) AS note FROM weights JOIN holdings USING (portfolio_id, asset) JOIN first_px USING (asset) WHERE asset <> '{P.FUND}'", down),
        panel("stress", "SELECT portfolio_id, scenario AS label, impact AS value, CASE WHEN coverage < 0.999 THEN coverage END AS note FROM stressed", up),
    ]
    low = "coalesce(r2 < 0.30, true)"
    return {
        "q_board": stressed + ", first_px AS (SELECT asset, min_by(px, d) AS first FROM prices GROUP BY asset) " + " UNION ALL ".join(board),
        "q_style_shown": f"""SELECT key, lag, {place('key', 'weight DESC', 'factor')}, factor, weight, round({bar('key', 'weight')}, 6) AS bar, r2, {low} AS low_fit,
            CASE WHEN NOT {low} THEN tracking_error END AS tracking_error, CASE WHEN NOT {low} THEN information_ratio END AS information_ratio FROM ({more['q_style']}) WHERE weight > 0.01""",
        "q_parity_shown": f"""WITH parity AS ({more['q_hrp']}), out AS (SELECT portfolio_id, string_agg(asset, ', ' ORDER BY asset) AS kept_out FROM parity WHERE cash_like GROUP BY 1)
            SELECT portfolio_id, {place('portfolio_id', 'weight DESC', 'asset')}, asset, weight, round({bar('portfolio_id', 'weight')}, 6) AS bar, kept_out FROM parity LEFT JOIN out USING (portfolio_id) WHERE weight IS NOT NULL""",
        "q_sharpe_shown": f"SELECT * REPLACE (round(exp(ann_return) - 1, 6) AS ann_return, round(exp(ann_rf) - 1, 6) AS ann_rf) FROM ({own['q_sharpe_choice']})",
        "q_price_scale": P.GAP.rstrip() + """, ends AS (SELECT asset, min(px) AS a, max(px) AS b FROM prices GROUP BY 1 HAVING count(px) > 1), spans AS (SELECT *, CASE WHEN b <> a THEN b - a WHEN b <> 0 THEN abs(b) ELSE 1.0 END AS s FROM ends)
            SELECT asset, round(a - 0.06 * s, 4) AS low, round(b + 0.06 * s, 4) AS high FROM spans""".replace("\n           ", ""),
    }
