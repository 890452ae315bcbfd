"""Backtests of VaR models on a volatility path, the model that passes best, and the volatility's place in its own history."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import chi2_1_p, safe_ln
from tidemark.operators.panel import gated
from tidemark.operators.risk import SEED_ROWS, filtered_historical, historical_var, next_sigma

MODELS = ["historical", "ewma", "fhs"]
#: Most days tested, least rows before them, least days, rows that a quantile looks back on, days of the zone bounds and the bounds.
MOST_DAYS, LEAST_BEFORE, LEAST_DAYS, LOOK_BACK, ZONE_DAYS, GREEN, YELLOW = 250, 150, 75, 500, 250, 4, 9


def violations(path: DataFrame, confidence: float = 0.99) -> DataFrame:
    """portfolio_id, model, i, hit (0 or 1): whether each tested day's return fell below the model's forecast from earlier rows."""
    p = 1 - confidence
    own = Window.partitionBy("portfolio_id")
    before = own.orderBy("i").rowsBetween(-LOOK_BACK, -1)
    days = F.least(F.lit(MOST_DAYS), F.col("n") - LEAST_BEFORE)
    near = path.withColumn("n", F.count("*").over(own)).where(F.col("i") >= F.col("n") - MOST_DAYS - LOOK_BACK)  # no tested day looks back further
    z = F.when(F.col("i") >= SEED_ROWS, F.try_divide("r", "sigma"))
    limits = [F.percentile("r", p).over(before), F.col("sigma") * NormalDist().inv_cdf(p), F.percentile(z, p).over(before) * F.col("sigma")]
    wide = near.select("portfolio_id", "i", "n", "r", *[x.alias(m) for m, x in zip(MODELS, limits, strict=True)])
    tested = wide.where((days >= LEAST_DAYS) & (F.col("i") >= F.col("n") - days))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("r") < F.col(m)).cast("int").alias("hit")) for m in MODELS]))
    return tested.select("portfolio_id", "i", each.alias("x")).select("portfolio_id", "x.model", "i", "x.hit")


def _likelihood(share: Column, hits: Column, others: Column) -> Column:
    return others * safe_ln(1 - share) + hits * safe_ln(share)


def backtest(path: DataFrame, confidence: float = 0.99) -> DataFrame:
    """A row for each portfolio and model: days, violations, expected, kupiec_p (coverage), christoffersen_p (independence) and
    zone by the violations in 250 days. Portfolios with too few days keep their rows, with nulls; christoffersen_p is null with
    fewer than two violations or without days after either kind of day."""
    p = 1 - confidence
    order = Window.partitionBy("portfolio_id", "model").orderBy("i")
    moved = violations(path, confidence).withColumn("was", F.lag("hit").over(order))
    both = lambda a, b: F.count_if((F.col("was") == a) & (F.col("hit") == b)).alias(f"n{a}{b}")
    s = moved.groupBy("portfolio_id", "model").agg(F.count("*").alias("days"), F.sum("hit").alias("violations"), both(0, 0), both(0, 1), both(1, 0), both(1, 1))
    n, x, n00, n01, n10, n11 = (F.col(c) for c in ("days", "violations", "n00", "n01", "n10", "n11"))
    coverage = -2 * (_likelihood(F.lit(p), x, n - x) - _likelihood(x / n, x, n - x))
    calm, hit, all_ = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11), F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    independence = -2 * (_likelihood(all_, n01 + n11, n00 + n10) - _likelihood(calm, n01, n00) - _likelihood(hit, n11, n10))
    scaled = x * ZONE_DAYS / n
    s = s.withColumn("uc", coverage).withColumn("ind", independence)  # columns of their own, for the distribution function names them often
    scored = s.select(
        "portfolio_id", "model", "days", "violations", (n * p).alias("expected"), chi2_1_p(F.col("uc")).alias("kupiec_p"),
        F.when((x >= 2) & (n00 + n01 > 0) & (n10 + n11 > 0), chi2_1_p(F.col("ind"))).alias("christoffersen_p"),
        F.when(scaled <= GREEN, "green").when(scaled <= YELLOW, "yellow").otherwise("red").alias("zone"),
    )
    all_rows = path.select("portfolio_id").distinct().select("portfolio_id", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))
    return all_rows.join(scored, ["portfolio_id", "model"], "left")


def headline(models: DataFrame) -> DataFrame:
    """portfolio_id, model, zone, kupiec_p of a backtest's model in the best zone, then of the highest coverage p, then first in order.

    Where no backtest was possible all models are alike, so the historical one is taken, without zone and p."""
    rank = F.when(F.col("zone") == "green", 2).when(F.col("zone") == "yellow", 1).when(F.col("zone") == "red", 0).otherwise(-1)
    place = F.array_position(F.array(*map(F.lit, MODELS)), F.col("model"))
    best = models.groupBy("portfolio_id").agg(F.max_by(F.struct("model", "zone", "kupiec_p"), F.struct(rank, F.coalesce("kupiec_p", F.lit(-1.0)), -place)).alias("b"))
    return best.select("portfolio_id", "b.*")


def headline_var(path: DataFrame, confidence: float = 0.99) -> DataFrame:
    """portfolio_id, model, var, zone, kupiec_p of the model that passes best (see headline); its historical VaR where it has no other."""
    fhs = filtered_historical(path, confidence).select("portfolio_id", "sigma_today", "var_fhs")
    vars_ = headline(backtest(path, confidence)).join(historical_var(path, confidence=confidence), "portfolio_id").join(fhs, "portfolio_id", "left")
    own = F.when(F.col("model") == "fhs", F.col("var_fhs")).when(F.col("model") == "ewma", F.col("sigma_today") * NormalDist().inv_cdf(1 - confidence))
    return vars_.select("portfolio_id", "model", F.coalesce(own, F.col("var")).alias("var"), "zone", "kupiec_p")


def vol_regime(path: DataFrame, least: int = 250) -> DataFrame:
    """The next day's volatility, its percentile among the path's (from row 30 on), and their median, by the year; null with too few rows."""
    year = F.sqrt(F.lit(252.0))
    now = next_sigma(path)
    past = path.where(F.col("i") >= SEED_ROWS).join(now, "portfolio_id")
    s = past.groupBy("portfolio_id").agg(F.avg((F.col("sigma") <= F.col("sigma_next")).cast("double")).alias("share"), F.percentile("sigma", 0.5).alias("mid"), F.count("*").alias("m"))
    all_ = now.join(s, "portfolio_id", "left")
    g = lambda c: gated(F.col("n"), least, c)
    return all_.select("portfolio_id", g(F.col("m")).alias("observations"), g(F.col("sigma_next") * year).alias("current_vol"), g(F.col("share")).alias("percentile"), g(F.col("mid") * year).alias("median_vol"))
