"""Kept prices: merging of sources by rank, snapshots that stand in for what is missing, replacement of single portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.store import Store

SCHEMA = "asset string, d date, px double"


def merged(*sources: DataFrame) -> DataFrame:
    """asset, d, px from sources(asset, d, seq, px), the first one that has an asset giving all its rows; a day's last row by seq counts.

    Prices that aren't positive are dropped first, so a source that has only such is passed over."""
    ranked = [s.where("px > 0").select("asset", "d", "seq", "px", F.lit(k).alias("rank")) for k, s in enumerate(sources)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    first = rows.withColumn("best", F.min("rank").over(Window.partitionBy("asset"))).where("rank = best")
    return first.groupBy("asset", "d").agg(F.max_by("px", "seq").alias("px"))


def with_fallback(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """fresh, and the kept rows of assets that fresh has nothing of."""
    return fresh.select("asset", "d", "px").unionByName(kept.join(fresh.select("asset").distinct(), "asset", "left_anti").select("asset", "d", "px"))


def store(spark: SparkSession, path: str) -> Store:
    """The store of price snapshots, by asset."""
    return Store(spark, path, "asset", SCHEMA)


def save(prices: DataFrame, path: str) -> None:
    """Keeps the prices of the assets that there are some of; the snapshots of all others stay as they are."""
    store(prices.sparkSession, path).replace(prices.select("asset", "d", "px"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return store(spark, path).read()


def refreshed(fresh: DataFrame, path: str) -> DataFrame:
    """with_fallback of fresh and what is kept, after what is fresh has been kept too."""
    kept = load(fresh.sparkSession, path)
    save(fresh, path)
    return with_fallback(fresh, kept)


def replace_portfolios(rows: DataFrame, path: str, portfolios: DataFrame | None = None, key: str = "portfolio_id") -> None:
    """Replaces the rows of the named portfolios, or of those that rows hold, and leaves all others; a named one without rows is emptied."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    Store(rows.sparkSession, path, key, kinds).replace(rows, portfolios)


def portfolios(spark: SparkSession, path: str, schema: str, key: str = "portfolio_id") -> DataFrame:
    return Store(spark, path, key, schema).read()
