"""What the figures of many portfolios share: each table is made once, on first use, for all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import allocation, backtest, panel, risk


class Book:
    """Portfolios holdings(portfolio_id, asset, quantity) at prices(asset, d, px), in one currency.

    keep(df, name) is applied to what several figures read: sources.tables.written makes it once, the default leaves it lazy."""

    def __init__(self, prices: DataFrame, holdings: DataFrame, confidence: float = 0.99, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df):
        self.prices, self.holdings, self.confidence, self.keep = prices, holdings, confidence, keep

    @cached_property
    def _sets(self) -> tuple[DataFrame, DataFrame]:
        of, members = panel.asset_sets(self.prices, self.holdings)
        return self.keep(of, "sets"), self.keep(members, "members")

    @cached_property
    def weights(self) -> DataFrame:
        """portfolio_id, asset, value, w, set_id."""
        return self.keep(panel.weights(self.holdings, self.prices, self._sets[0]), "weights")

    @cached_property
    def values(self) -> DataFrame:
        return self.weights.groupBy("portfolio_id").agg(F.sum("value").alias("value"))

    @cached_property
    def returns(self) -> DataFrame:
        """set_id, asset, d, r on each set's own calendar."""
        return self.keep(panel.set_returns(self.prices, self._sets[1]), "returns")

    @cached_property
    def series(self) -> DataFrame:
        """portfolio_id, d, i, r."""
        return self.keep(panel.portfolio_returns(self.returns, self.weights), "series")

    @cached_property
    def path(self) -> DataFrame:
        """portfolio_id, i, r, sigma."""
        return self.keep(risk.ewma_path(self.series), "path")

    @cached_property
    def moments(self) -> DataFrame:
        return self.keep(allocation.pair_moments(self.returns), "moments")

    @cached_property
    def covariance(self) -> DataFrame:
        return self.keep(allocation.shrunk_covariance(self.moments, self.weights), "covariance")

    @cached_property
    def models(self) -> DataFrame:
        """The backtest of each portfolio's VaR models."""
        return self.keep(backtest.backtest(self.path, self.confidence), "models")

    @cached_property
    def figures(self) -> DataFrame:
        return self.keep(figures(self), "figures")


def figures(book: Book) -> DataFrame:
    """A row for each portfolio with returns: n, value, the historical, normal and filtered VaR and shortfall, and the headline VaR.

    var is that of the model that passes its backtest best (see backtest.headline), var_value the same in money, and scale its
    ratio to the historical VaR: what is computed from historical quantiles is multiplied by it, so that all figures of an analysis
    stand on one VaR. Too few rows give nulls; without a headline the historical VaR and a scale of 1 remain."""
    c = book.confidence
    shortfall = risk.expected_shortfall(book.series, c).select("portfolio_id", "es")
    wide = risk.expected_shortfall(book.series, 0.975).select("portfolio_id", F.col("es").alias("es_975"))
    plain = risk.historical_var(book.series, confidence=c).withColumnRenamed("var", "var_historical")
    fhs = risk.filtered_historical(book.path, c).drop("n")
    rows = plain.join(shortfall, "portfolio_id").join(wide, "portfolio_id").join(fhs, "portfolio_id").join(risk.parametric(book.path, c), "portfolio_id")
    rows = rows.join(backtest.headline(book.models), "portfolio_id", "left").join(book.values, "portfolio_id")
    own = F.when(F.col("model") == "fhs", F.col("var_fhs")).when(F.col("model") == "ewma", F.col("var_ewma"))
    var = F.coalesce(own, F.col("var_historical"))
    scale = F.when(F.col("var_historical") != 0, var / F.col("var_historical")).otherwise(1.0)
    return rows.select(
        "portfolio_id", "n", "value", "var_historical", "es", "es_975", "sigma_today", "var_ewma", "es_ewma", "var_fhs", "es_fhs", F.coalesce("model", F.lit("historical")).alias("model"), "zone", "kupiec_p",
        var.alias("var"), scale.alias("scale"), (var * F.col("value")).alias("var_value"),
    )


def diversification(book: Book) -> DataFrame:
    """portfolio_id, sum_var, portfolio_var, benefit: risk.diversification on the headline VaR."""
    plain = risk.diversification(book.returns, book.weights, book.series, book.confidence)
    scaled = plain.join(book.figures.select("portfolio_id", "scale"), "portfolio_id")
    return scaled.select("portfolio_id", *[(F.col(c) * F.col("scale")).alias(c) for c in ("sum_var", "portfolio_var", "benefit")])


def attribution(book: Book) -> DataFrame:
    """allocation.attribution of the headline VaR: the components sum to it."""
    return allocation.attribution(book.covariance, book.weights, book.figures)


def liquidity_var(book: Book, exits: DataFrame) -> DataFrame:
    """portfolio_id, multiplier, var_value, lvar_value: the headline VaR over the days that leaving takes, by exposure.liquidity."""
    by = exits.groupBy("portfolio_id").agg(F.max("lvar_multiplier").alias("multiplier"))
    both = by.join(book.figures.select("portfolio_id", "var_value"), "portfolio_id", "left")
    return both.select("portfolio_id", "multiplier", "var_value", (F.col("var_value") * F.col("multiplier")).alias("lvar_value"))
