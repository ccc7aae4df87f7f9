"""Synthetic point-of-sale ledger (A10), generated by Spark from parameters.

Every random draw is a hash of (seed, day, product, purpose), so a row does
not depend on partitioning or on which executor produced it, and a re-run
(or a retried task) yields the same ledger. Rows: one sold line per (day,
product) and one negative waste line when the day has waste. This is a demo
and test-data generator only; no registered query reads it.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default demo products (the first has the higher base demand), price per unit.
DEMO_PRODUCTS = ["Croissant", "Baguette", "Sourdough Loaf", "Glazed Donut"]
UNIT_PRICE = 3500


def _uniform(seed: int, *parts: Column | str) -> Column:
    """A uniform draw in [0, 1) from a 64-bit hash of the seed and the parts."""
    h = F.xxhash64(F.lit(seed), *parts, F.lit(len(parts)))
    return (F.abs(h % F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))


def _normal(seed: int, mean: float, sd: float, *parts: Column | str) -> Column:
    """Box-Muller normal draw from two hashed uniforms."""
    u1 = F.greatest(_uniform(seed, *parts, F.lit("u1")), F.lit(1e-12))
    u2 = _uniform(seed, *parts, F.lit("u2"))
    return F.lit(mean) + F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def synth_ledger(spark: SparkSession, days: int = 365, products: Sequence[str] = DEMO_PRODUCTS, seed: int = 42,
                 start: dt.date | None = None, rain_sensitive: str = "Glazed Donut") -> DataFrame:
    """Raw ledger with the export's headers: No., 상품명, 수량, 실매출, weather, temp_avg/max/min.

    Season: base 25 in Jun-Aug, 5 in Dec-Feb, else 15, plus normal(0, 5) noise;
    weather Snow below 0, else Rainy with p=.3, else Cloudy with p=.5, else
    Sunny; demand 50 for the first product, 30 for others, x1.5 on weekends,
    x0.7 for the rain-sensitive product on rainy days; sold = max(5, N(demand, 10));
    waste = |N(5, 3)| (a negative line when > 0).
    """
    start = start or dt.date(2024, 1, 1)
    d = spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    m = F.month("day")
    base_t = F.when(m.isin(6, 7, 8), 25.0).when(m.isin(12, 1, 2), 5.0).otherwise(15.0)
    dkey = F.date_format("day", "yyyy-MM-dd")
    d = d.withColumn("temp", F.round(base_t + _normal(seed, 0.0, 5.0, dkey, F.lit("temp")), 1))
    weather = (
        F.when(F.col("temp") < 0, "Snow")
        .when(_uniform(seed, dkey, F.lit("rain")) < 0.3, "Rainy")
        .when(_uniform(seed, dkey, F.lit("cloud")) < 0.5, "Cloudy")
        .otherwise("Sunny")
    )
    d = d.withColumn("weather", weather)
    lines = d.select("*", F.posexplode(F.array(*[F.lit(p) for p in products])).alias("pidx", "product"))
    demand = F.when(F.col("pidx") == 0, 50).otherwise(30)
    demand = F.when(F.weekday("day") >= 5, F.floor(demand * 1.5)).otherwise(demand)
    demand = F.when((F.col("weather") == "Rainy") & (F.col("product") == rain_sensitive), F.floor(demand * 0.7)).otherwise(demand)
    sold = F.greatest(F.lit(5), _normal(seed, 0.0, 10.0, dkey, F.col("product"), F.lit("sold")).cast("int") + demand.cast("int"))
    waste = F.abs(_normal(seed, 5.0, 3.0, dkey, F.col("product"), F.lit("waste")).cast("int"))
    q = lines.select("day", "product", "weather", "temp", sold.alias("sold"), waste.alias("waste"))
    entries = q.select(
        "*", F.explode(F.array(F.struct(F.col("sold").alias("qty"), (F.col("sold") * UNIT_PRICE).alias("sales")),
                               F.struct((-F.col("waste")).alias("qty"), F.lit(0).alias("sales")))).alias("e")
    ).filter(F.col("e.qty") != 0)
    return entries.select(
        F.date_format("day", "yyyy-MM-dd").alias("No."),
        F.col("product").alias("상품명"),
        F.col("e.qty").cast("long").alias("수량"),
        F.col("e.sales").cast("long").alias("실매출"),
        "weather",
        F.col("temp").alias("temp_avg"),
        F.round(F.col("temp") + 5, 1).alias("temp_max"),
        F.round(F.col("temp") - 5, 1).alias("temp_min"),
    )
