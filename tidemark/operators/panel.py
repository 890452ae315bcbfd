"""The price panel in long form: cleaning, calendars, alignment, returns, fills."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the days are dealt where portfolios of one set of assets meet its returns.
DAY_BLOCKS = 16


def clean(prices: DataFrame) -> DataFrame:
    """Rows with a positive price; anything else counts as no trade."""
    return prices.where("px > 0")


def log_returns(prices: DataFrame) -> DataFrame:
    """asset, d, r on the dates on which every asset trades; a return spans the dates left out."""
    good = clean(prices)
    assets = good.agg(F.countDistinct("asset").alias("n_assets"))
    full = good.groupBy("d").agg(F.count("*").alias("n")).join(F.broadcast(assets), F.expr("n = n_assets")).select("d")  # one row
    w = Window.partitionBy("asset").orderBy("d")
    return good.join(full, "d").select("asset", "d", F.log(F.col("px") / F.lag("px").over(w)).alias("r")).where("r IS NOT NULL")


def asset_sets(prices: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(portfolio_id, set_id; set_id, asset): portfolios by the set of priced assets that they hold, and the assets of each set.

    Portfolios of equal sets share a calendar, so what is aligned once for a set serves them all. An asset without any
    positive price is in no set, and a portfolio of such alone has none. Sets are told apart by 128 bits of hash and their size."""
    priced = clean(prices).select("asset").distinct()
    held = holdings.select("portfolio_id", "asset").distinct().join(priced, "asset", "left_semi")
    hashed = [F.bit_xor(F.xxhash64("asset")), F.bit_xor(F.xxhash64(F.lit(1), "asset"))]
    of = held.groupBy("portfolio_id").agg(F.concat_ws("-", F.count("*"), *map(F.hex, hashed)).alias("set_id"))
    one = of.groupBy("set_id").agg(F.min("portfolio_id").alias("portfolio_id"))
    return of, held.join(one, "portfolio_id").select("set_id", "asset")


def set_returns(prices: DataFrame, members: DataFrame) -> DataFrame:
    """set_id, asset, d, r of sets(set_id, asset): log returns on the dates on which all assets of the set trade.

    A return spans the dates left out. Rows grow with the assets of the distinct sets, not with the portfolios."""
    rows = clean(prices).join(members, "asset")
    size = members.groupBy("set_id").agg(F.count("*").alias("n_assets"))
    day = Window.partitionBy("set_id", "d")
    full = rows.join(size, "set_id").withColumn("n", F.count("*").over(day)).where("n = n_assets")
    w = Window.partitionBy("set_id", "asset").orderBy("d")
    return full.select("set_id", "asset", "d", F.log(F.col("px") / F.lag("px").over(w)).alias("r")).where("r IS NOT NULL")


def held_returns(prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """portfolio_id, asset, d, r on the dates on which all assets of the portfolio trade, whatever others hold; see asset_sets."""
    of, members = asset_sets(prices, holdings)
    return set_returns(prices, members).join(of, "set_id").select("portfolio_id", "asset", "d", "r")


def position_changes(prices: DataFrame, days: int = 7) -> DataFrame:
    """asset, last, previous_change, period_change: the last price against the one before, and against that of so many calendar days before.

    The price of a day without trade is the last one before it; null where there is no earlier row, or none so far back."""
    good = clean(prices)
    w = Window.partitionBy("asset").orderBy("d")
    two = good.withColumn("before", F.lag("px").over(w)).groupBy("asset").agg(F.max_by(F.struct("px", "before"), "d").alias("l"), F.max("d").alias("d"))
    past = two.select("asset", F.date_sub("d", days).alias("then")).join(good, "asset").where("d <= then").groupBy("asset").agg(F.max_by("px", "d").alias("past"))
    return two.join(past, "asset", "left").select("asset", F.col("l.px").alias("last"), (F.col("l.px") / F.col("l.before") - 1).alias("previous_change"), (F.col("l.px") / F.col("past") - 1).alias("period_change"))


def daily_fill(series: DataFrame, keys: list[str], value: str = "px") -> DataFrame:
    """A row for each calendar day between a key's first and last, with the last known value carried on."""
    span = series.groupBy(*keys).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("d"))
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(series, [*keys, "d"], "left").select(*keys, "d", F.last(value, True).over(w).alias(value))


def weights(holdings: DataFrame, prices: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """portfolio_id, asset, value, w, and set_id with sets `of` portfolios: positions at the last price; duplicate positions of an asset are summed."""
    last = clean(prices).groupBy("asset").agg(F.max_by("px", "d").alias("last"))
    value = holdings.groupBy("portfolio_id", "asset").agg(F.sum("quantity").alias("q")).join(last, "asset").select("portfolio_id", "asset", (F.col("q") * F.col("last")).alias("value"))
    total = F.sum("value").over(Window.partitionBy("portfolio_id"))
    rows = value.withColumn("w", F.when(total > 0, F.col("value") / total))
    return rows if of is None else rows.join(of, "portfolio_id")


def portfolio_returns(returns: DataFrame, w: DataFrame) -> DataFrame:
    """portfolio_id, d, i (from 0), r: weighted sums of the assets' returns.

    Returns and weights with a set_id (see asset_sets) meet by set: a set's day is one row with its assets' returns in order, a
    portfolio one row with their weights, so the join makes a row for each portfolio and day. Days are dealt into DAY_BLOCKS,
    so that a set that a third of all portfolios hold isn't one task. Without a set_id they meet by asset."""
    if "set_id" in returns.columns and "set_id" in w.columns:
        block = F.pmod(F.hash("d"), F.lit(DAY_BLOCKS))
        day = returns.groupBy("set_id", "d").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("rs")).withColumn("block", block)
        own = w.groupBy("portfolio_id", "set_id").agg(F.array_sort(F.collect_list(F.struct("asset", "w"))).alias("ws")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(DAY_BLOCKS - 1))))
        r = day.join(own, ["set_id", "block"]).select("portfolio_id", "d", F.aggregate(F.zip_with("ws", "rs", lambda a, b: a["w"] * b["r"]), F.lit(0.0), lambda s, x: s + x).alias("r"))
    else:
        r = returns.join(w, "asset").groupBy("portfolio_id", "d").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return r.withColumn("i", F.row_number().over(Window.partitionBy("portfolio_id").orderBy("d")) - 1)


def portfolio_quantiles(returns: DataFrame, w: DataFrame, share: float, most: int = 500) -> DataFrame:
    """portfolio_id, n, q: the number of a portfolio's returns, as portfolio_returns has them, and their quantile, interpolated linearly.

    returns and weights need a set_id. No row is made for a portfolio and day: a set's returns are one row, days by assets, and its
    portfolios meet it some `most` at a time, dealt by hash, so that neither a large set is one task nor its returns are sent for each
    portfolio. In a task the returns of `most` portfolios are held at once. A portfolio without weights has no returns and a null quantile."""
    day = returns.groupBy("set_id", "d").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("rs"))
    sets = day.groupBy("set_id").agg(F.count("*").alias("days"), F.flatten(F.collect_list(F.transform("rs", lambda x: x["r"]))).alias("r"))
    own = w.groupBy("portfolio_id", "set_id").agg(F.array_sort(F.collect_list(F.struct("asset", "w"))).alias("ws"))
    parts = own.groupBy("set_id").agg(F.ceil(F.count("*") / most).alias("parts"))
    part = F.pmod(F.xxhash64("portfolio_id"), F.col("parts")).alias("part")
    dealt = own.join(parts, "set_id").select("set_id", part, "portfolio_id", F.transform("ws", lambda x: x["w"]).alias("w"))
    lots = dealt.groupBy("set_id", "part").agg(F.collect_list("portfolio_id").alias("ids"), F.flatten(F.collect_list("w")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, weights, days, r = (b.column(c)[k] for c in range(4))
                x = r.values.to_numpy(zero_copy_only=False).reshape(days.as_py(), -1)
                table = weights.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                known = ~np.isnan(table).any(axis=1)  # without a value there are no weights
                series = np.zeros((int(known.sum()), len(x)))
                for a in range(x.shape[1]):  # asset by asset, as portfolio_returns adds
                    series += table[known, a : a + 1] * x[:, a]
                q = np.full(len(ids), np.nan)
                q[known] = np.quantile(series, share, axis=1, overwrite_input=True)
                n = np.where(known, len(x), 0)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(q, mask=~known)], names=["portfolio_id", "n", "q"])

    both = lots.join(sets, "set_id").select("ids", "w", "days", "r")
    return both.mapInArrow(run, "portfolio_id string, n long, q double")


def gated(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)
