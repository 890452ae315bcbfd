"""Bond analytics: price from the yield, durations, value of a basis point and rate shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOCKS_BP = [-100, 100, 300, 500]


def metrics(bonds: DataFrame) -> DataFrame:
    """bonds with fair (per 100), macaulay, modified, value and dv01."""
    n = F.greatest(F.lit(1), F.rint(F.col("years") * F.col("frequency")).cast("int"))
    y, coupon = F.col("ytm") / F.col("frequency"), 100.0 * F.col("coupon") / F.col("frequency")
    pv = lambda k: (coupon + F.when(k == n, 100.0).otherwise(0.0)) * F.pow(1 + y, -k.cast("double"))
    zero = F.lit(0.0)
    fair = F.aggregate(F.sequence(F.lit(1), n), zero, lambda a, k: a + pv(k))
    timed = F.aggregate(F.sequence(F.lit(1), n), zero, lambda a, k: a + pv(k) * k / F.col("frequency"))
    out = bonds.withColumn("fair", fair).withColumn("macaulay", timed / F.col("fair"))
    out = out.withColumn("modified", F.col("macaulay") / (1 + y)).withColumn("value", F.col("nominal") * F.col("price") / 100.0)
    return out.withColumn("dv01", F.col("modified") * F.col("value") * 1e-4)


def summary(measured: DataFrame) -> DataFrame:
    """A row for each rate shock: basket value, its duration by value, and what the shock takes or gives."""
    total = measured.agg(F.sum("value").alias("value"), F.try_divide(F.sum(F.col("modified") * F.col("value")), F.sum("value")).alias("duration"))
    return total.select("value", "duration", F.explode(F.array(*map(F.lit, SHOCKS_BP))).alias("shock_bp")).withColumn("impact", -F.col("duration") * F.col("value") * F.col("shock_bp") / 10000.0)
