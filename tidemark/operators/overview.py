"""What an overview of portfolios shows: ranked bars, styles worth showing, simple rates for logarithmic ones, scales of lines.

A portfolio's rows of a panel meet in one window: they are bounded by its positions or by the scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least weight of a style that is shown, the least fit of one that is told of, the coverage that counts as whole, and the margin of a line.
LEAST_WEIGHT, LEAST_FIT, WHOLE, MARGIN = 0.01, 0.30, 0.999, 0.06


def bars(rows: DataFrame, key: str, label: str, value: str, descending: bool = True, digits: int = 2) -> DataFrame:
    """rows with place and bar: the place among the key's rows by the rounded value, ties by label, and the value's size against the largest.

    Rows without a value aren't shown; where all values are 0, so are all bars."""
    own = Window.partitionBy(key)
    by = F.round(value, digits)
    shown = rows.where(F.col(value).isNotNull())
    return shown.withColumns({"place": F.row_number().over(own.orderBy(by.desc() if descending else by.asc(), label)), "bar": F.abs(value) / F.greatest(F.max(F.abs(value)).over(own), F.lit(1e-9))})


def board(positions: DataFrame, stressed: DataFrame) -> DataFrame:
    """portfolio_id, panel, place, label, value, bar, note: allocation and gains from the largest, stress from the worst.

    positions(portfolio_id, asset, value, cost), a null cost where none is known; stressed: exposure.stress. The note is the share of the
    whole, the gain on the cost, or the coverage of a scenario that isn't whole. Positions without a value or a gain, and
    scenarios without data, aren't shown in the panel."""
    whole = F.sum("value").over(Window.partitionBy("portfolio_id"))
    held = positions.select("portfolio_id", F.col("asset").alias("label"), "value", F.try_divide("value", whole).alias("note"))
    gained = positions.select("portfolio_id", F.col("asset").alias("label"), (F.col("value") - F.col("cost")).alias("value"), F.try_divide(F.col("value") - F.col("cost"), F.col("cost")).alias("note"))
    hit = stressed.select("portfolio_id", F.col("scenario").alias("label"), F.col("impact").alias("value"), F.when(F.col("coverage") < WHOLE, F.col("coverage")).alias("note"))
    panels = [("allocation", held, True), ("gains", gained, True), ("stress", hit, False)]
    first, *others = [bars(rows, "portfolio_id", "label", "value", down).select("portfolio_id", F.lit(name).alias("panel"), "place", "label", "value", "bar", "note") for name, rows, down in panels]
    for other in others:
        first = first.unionAll(other)
    return first


def shown_styles(styles: DataFrame) -> DataFrame:
    """key, lag, place, factor, weight, bar, r2, low_fit, tracking_error, information_ratio: the factors of more than LEAST_WEIGHT, the heaviest first.

    styles: factors.style. A fit that is missing or below LEAST_FIT is marked, and no error or ratio is told for it."""
    low = F.coalesce(F.col("r2") < LEAST_FIT, F.lit(True))
    told = [F.when(~low, F.col(c)).alias(c) for c in ("tracking_error", "information_ratio")]
    return bars(styles.where(F.col("weight") > LEAST_WEIGHT), "key", "factor", "weight", digits=6).select("key", "lag", "place", "factor", "weight", "bar", "r2", low.alias("low_fit"), *told)


def shown_parity(parity: DataFrame) -> DataFrame:
    """portfolio_id, place, asset, weight, bar, kept_out: the heaviest first, with the names that are like cash, or null.

    parity: structure.hierarchical_parity. A portfolio without weights isn't shown."""
    out = parity.where("cash_like").groupBy("portfolio_id").agg(F.array_join(F.array_sort(F.collect_list("asset")), ", ").alias("kept_out"))
    ranked = bars(parity, "portfolio_id", "asset", "weight", digits=6)
    return ranked.join(out, "portfolio_id", "left").select("portfolio_id", "place", "asset", "weight", "bar", "kept_out")


def simple(rate: Column) -> Column:
    """The simple rate of a logarithmic one, as people compare it with a bank's."""
    return F.expm1(rate)


def shown_sharpe(ratios: DataFrame) -> DataFrame:
    """ratios (of rates.sharpe_by_choice) with the year's return and benchmark as simple rates; ratio and volatility stay."""
    return ratios.withColumns({c: simple(F.col(c)) for c in ("ann_return", "ann_rf")})


def line_scale(points: DataFrame, key: str, value: str) -> DataFrame:
    """key, low, high: the values' span and MARGIN of it on both sides; a level line spans its own size, one at 0 spans 1. Fewer than two values: no line."""
    span = F.coalesce(F.nullif(F.col("b") - F.col("a"), F.lit(0.0)), F.nullif(F.abs("b"), F.lit(0.0)), F.lit(1.0))
    ends = points.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("n")).where("n > 1")
    return ends.select(key, (F.col("a") - MARGIN * span).alias("low"), (F.col("b") + MARGIN * span).alias("high"))
