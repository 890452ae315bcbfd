"""Long-format inputs of the risk operators, read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMOOTHING = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, d, px: the average unit price over the last twenty trading days of each return flag; sums are exact."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("date").alias("d"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("e"), F.sum(F.col("l_quantity").cast("long")).alias("n"))
    )
    w = Window.partitionBy("asset").orderBy("d").rowsBetween(1 - SMOOTHING, 0)
    return daily.select("asset", "d", (F.sum("e").over(w).cast("double") / F.sum("n").over(w).cast("double")).alias("px"))


def sparse_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, d, px with gaps: the average order value by priority."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("d"))
    return o.agg((F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / F.count("*")).alias("px"))


def gap_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, d, px with gaps that differ by asset: the average order value by priority over its last twenty trading days; sums are exact."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("d"))
    daily = o.agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("e"), F.count("*").alias("n"))
    w = Window.partitionBy("asset").orderBy("d").rowsBetween(1 - SMOOTHING, 0)
    return daily.select("asset", "d", (F.sum("e").over(w).cast("double") / F.sum("n").over(w)).alias("px"))


def gap_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio_id, asset, quantity: each segment's and nation's orders by priority; by its number, a nation goes without some priorities."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).where((F.col("c_nationkey") + F.substring("o_orderpriority", 1, 1).cast("int")) % 3 != 0)
    return rows.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey")).alias("portfolio_id"), F.col("o_orderpriority").alias("asset")).agg(F.count("*").cast("double").alias("quantity"))


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, v: the average order value of each month, at its last day, as an index of consumer prices."""
    o = table(spark, sf_dir, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("d"))
    return o.agg((F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / F.count("*")).alias("v"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio_id, asset, quantity: what the customers of each market segment bought."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    all_ = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return all_.groupBy(F.col("c_mktsegment").alias("portfolio_id"), F.col("l_returnflag").alias("asset")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("quantity"))


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bond_id, coupon, years, ytm, frequency, nominal, price per 100 of each part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("bond_id"), (F.col("p_size") / 100.0).alias("coupon"), (1 + F.col("p_size") % 10).cast("double").alias("years"), (0.05 + (k % 20) / 100.0).alias("ytm"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (k % 3 + 1).cast("int")).alias("frequency"), (F.col("p_retailprice").cast("double") * 100.0).alias("nominal"), F.lit(95.0).alias("price"),
    )
