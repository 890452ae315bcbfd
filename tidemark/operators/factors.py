"""Several factors: sums of squares and products by Spark, and small regressions and style weights from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of a currency shock that reaches consumer prices in a year; steps of the style solver; least days.
PASS_THROUGH, STEPS, LEAST = 0.4, 2000, 120


def log_panel(prices: DataFrame) -> DataFrame:
    """factor, d, f: log change of each factor(factor, d, px) from its row before, only on days on which all factors have one."""
    w = Window.partitionBy("factor").orderBy("d")
    moved = prices.where("px > 0").select("factor", "d", F.log(F.col("px") / F.lag("px").over(w)).alias("f")).where("f IS NOT NULL")
    n = moved.agg(F.countDistinct("factor").alias("n_factors"))
    full = moved.groupBy("d").agg(F.count("*").alias("n")).join(F.broadcast(n), F.expr("n = n_factors")).select("d")  # one row
    return moved.join(full, "d")


def with_cash(panel: DataFrame, rates: DataFrame, name: str = "cash") -> DataFrame:
    """The panel and one more factor: the daily log return of rates(d, rate), annual, carried on along the panel's own days."""
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    days = panel.select("d").distinct().join(rates.select("d", "rate"), "d", "left")
    cash = days.select(F.lit(name).alias("factor"), "d", (F.log(1 + F.last("rate", True).over(w)) / 252).alias("f")).where("f IS NOT NULL")
    return panel.unionByName(cash)


def style_panel(prices: DataFrame, plain: dict[str, str], converted: dict[str, str], currency: str, rates: DataFrame | None = None, annual: float = 0.4, cash: str = "cash") -> DataFrame:
    """factor, d, f: the factors that a fund's style is sought in, by name: plain ones, ones converted at the rate of exchange, and cash.

    prices(asset, d, px). Changes are those from row to row of the calendar on which anything listed is quoted: a factor has none on a
    day that it, or its row before, lacks; nothing is dropped for the others' sake, so that each fund loses only its own days (see
    moments). A converted factor is the price times the currency's last known rate. Cash is the daily log return of rates(d, rate),
    carried on along the calendar, or of the constant annual rate without them."""
    used = [*plain.values(), *converted.values(), currency]
    rows = prices.where(F.col("asset").isin(used)).select("asset", "d", F.when(F.col("px") > 0, F.col("px")).alias("px"))
    day = rows.groupBy("d").agg(*[F.max(F.when(F.col("asset") == a, F.col("px"))).alias(f"x{k}") for k, a in enumerate(used)])
    order = Window.orderBy("d")  # one row a day, made by an aggregate
    day = day.withColumn("fx", F.last(f"x{len(used) - 1}", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    value = {n: F.col(f"x{k}") for k, n in enumerate(plain)} | {n: F.col(f"x{len(plain) + k}") * F.col("fx") for k, n in enumerate(converted)}
    wide = day.select("d", *[v.alias(f"v{k}") for k, v in enumerate(value.values())])
    change = [F.struct(F.lit(n).alias("factor"), F.log(F.col(f"v{k}") / F.lag(f"v{k}").over(order)).alias("f")) for k, n in enumerate(value)]
    if rates is None:
        idle = F.lit(math.log(1 + annual) / 252)
    else:
        wide = wide.join(rates.select("d", "rate"), "d", "left")
        idle = F.log(1 + F.last("rate", True).over(order.rowsBetween(Window.unboundedPreceding, 0))) / 252
    every = wide.select("d", F.array(*change, F.struct(F.lit(cash).alias("factor"), idle.alias("f"))).alias("a"))
    return every.select("d", F.inline("a")).select("factor", "d", "f").where("f IS NOT NULL")


def moments(targets: DataFrame, panel: DataFrame, names: list[str], max_lag: int = 0) -> DataFrame:
    """key, lag, n, sy, syy, sx, sxy, sxx of targets(key, d, r) on the named factors, on days on which all are known.

    lag k sets a day's factors against the return k rows later. One shuffle by day, one by key; the sums combine before the second."""
    k, w = len(names), Window.partitionBy("key").orderBy("d")
    x = panel.groupBy("d").agg(F.array(*[F.max(F.when(F.col("factor") == n, F.col("f"))) for n in names]).alias("x")).where(F.expr("forall(x, v -> v IS NOT NULL)"))
    later = F.array(*[F.struct(F.lit(g).alias("lag"), F.lead("r", g).over(w).alias("y")) for g in range(max_lag + 1)])
    rows = targets.select("key", "d", later.alias("later")).select("key", "d", F.inline("later")).where("y IS NOT NULL").join(x, "d")
    at = lambda i: F.col("x")[i]
    return rows.groupBy("key", "lag").agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"), F.array(*[F.sum(at(i)) for i in range(k)]).alias("sx"),
        F.array(*[F.sum(at(i) * F.col("y")) for i in range(k)]).alias("sxy"), F.array(*[F.sum(at(i) * at(j)) for i in range(k) for j in range(k)]).alias("sxx"),
    )


def _arrays(row: object) -> tuple[int, float, float, np.ndarray, np.ndarray, np.ndarray]:
    k = len(row.sx)
    return row.n, row.sy, row.syy, np.array(row.sx), np.array(row.sxy), np.array(row.sxx).reshape(k, k)


def betas(sums: DataFrame, names: list[str], least: int = LEAST) -> DataFrame:
    """key, lag, n, r2, factor, beta: least squares with a constant at the lag that explains most, the smaller one on ties.

    A lag needs `least` days; a key without one has no row. Factors that depend on one another share their weight."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                n, sy, syy, sx, sxy, sxx = _arrays(row)
                c = sxy - sx * sy / n
                b = np.linalg.pinv(sxx - np.outer(sx, sx) / n, hermitian=True) @ c
                whole = syy - sy * sy / n
                out.append((row.key, row.lag, n, float(b @ c / whole) if whole > 0 else 0.0, list(map(float, b))))
            yield pd.DataFrame(out, columns=["key", "lag", "n", "r2", "beta"])

    fitted = sums.where(F.col("n") >= least).mapInPandas(solve, "key string, lag int, n long, r2 double, beta array<double>")
    best = fitted.groupBy("key").agg(F.max_by(F.struct("lag", "n", "r2", "beta"), F.struct("r2", (-F.col("lag")).alias("g"))).alias("b")).select("key", "b.*")
    listed = F.arrays_zip(F.array(*map(F.lit, names)).alias("factor"), F.col("beta").alias("beta"))
    return best.select("key", "lag", "n", "r2", F.inline(listed).alias("factor", "beta"))


def portfolio_betas(asset_betas: DataFrame, weights: DataFrame) -> DataFrame:
    """portfolio_id, factor, beta: weighted sums of the assets' betas; assets without a fit are left out and nothing is scaled up."""
    return weights.join(asset_betas, F.col("asset") == F.col("key")).groupBy("portfolio_id", "factor").agg(F.sum(F.col("w") * F.col("beta")).alias("beta"))


def real_impact(grid: DataFrame, shocks: list[tuple[str, str, float]], currency: str, share: float = PASS_THROUGH) -> DataFrame:
    """A shock grid with change_real: the change less what a shock to the currency factor adds to prices."""
    moved: dict[str, float] = {}
    for scenario, factor, x in shocks:
        moved[scenario] = moved.get(scenario, 0.0) + (x if factor == currency else 0.0)
    cost = F.lit(0.0)
    for scenario, x in moved.items():
        cost = F.when(F.col("scenario") == scenario, share * x).otherwise(cost)
    return grid.withColumn("change_real", F.col("change") - cost)


def _to_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with parts of at least 0 that sum to 1: what lies over one level, found from the largest parts."""
    top = np.sort(v)[::-1]
    level = (np.cumsum(top) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - level[np.flatnonzero(top > level)[-1]], 0)


def style(sums: DataFrame, names: list[str], least: int = LEAST) -> DataFrame:
    """key, lag, n, r2, tracking_error, alpha, information_ratio, factor, weight: the mix of factors nearest to each key.

    Weights are at least 0 and sum to 1, by STEPS projected steps from equal ones; the lag that explains most counts, the smaller on ties."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                n, sy, syy, sx, sxy, sxx = _arrays(row)
                w, step = np.full(len(sx), 1 / len(sx)), 1 / max(np.linalg.norm(sxx, 2), 1e-8)
                for _ in range(STEPS):
                    w = _to_simplex(w - step * (sxx @ w - sxy))
                left, mean = float(syy - 2 * w @ sxy + w @ sxx @ w), float(sy - w @ sx) / n
                whole, error = syy - sy * sy / n, float(np.sqrt(max(left / n - mean * mean, 0) * 252))
                out.append((row.key, row.lag, n, 1 - left / whole if whole > 0 else None, error, mean * 252, mean * 252 / error if error > 0 else None, list(map(float, w))))
            yield pd.DataFrame(out, columns=["key", "lag", "n", "r2", "tracking_error", "alpha", "information_ratio", "weight"])

    fitted = sums.where(F.col("n") >= least).mapInPandas(solve, "key string, lag int, n long, r2 double, tracking_error double, alpha double, information_ratio double, weight array<double>")
    rank = F.struct(F.coalesce("r2", F.lit(0.0)).alias("r"), (-F.col("lag")).alias("g"))
    best = fitted.groupBy("key").agg(F.max_by(F.struct(*fitted.columns[1:]), rank).alias("b")).select("key", "b.*")
    listed = F.arrays_zip(F.array(*map(F.lit, names)).alias("factor"), F.col("weight").alias("weight"))
    return best.select("key", "lag", "n", "r2", "tracking_error", "alpha", "information_ratio", F.inline(listed).alias("factor", "weight"))
