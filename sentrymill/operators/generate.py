"""Event streams for tests and demonstrations, from spark.range and keyed hashes: same seed, same rows, any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """[0, 1) from a hash of keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def events(spark: SparkSession, entities: int, days: int, mean_per_day: float = 4.0, bad_share: float = 0.05, seed: int = 1) -> DataFrame:
    """Role-named events: counts by geometric draw, log-normal amounts, hourly shape, bad entities bursting from an onset day."""
    e = spark.range(entities).select(F.col("id").alias("entity"))
    e = e.withColumn("bad", uniform(seed, F.col("entity"), F.lit("bad")) < bad_share).withColumn("onset", (uniform(seed, F.col("entity"), F.lit("on")) * days).cast("int"))
    cells = e.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    rate = F.lit(mean_per_day) * F.when(F.col("bad") & (F.col("day") >= F.col("onset")), 3.0).otherwise(1.0)
    n = F.floor(F.ln(1 - uniform(seed, F.col("entity"), F.col("day"))) / F.ln(rate / (1 + rate))).cast("int")
    rows = cells.withColumn("n", n).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = lambda name: uniform(seed, F.col("entity"), F.col("day"), F.col("k"), F.lit(name))
    normal = F.sqrt(-2 * F.ln(1 - u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    seconds = F.col("day") * 86400 + (u("t") * 86400).cast("int")
    return rows.select(
        F.xxhash64("entity", "day", "k").alias("event_id"), "entity", F.floor(u("p") * 50).cast("string").alias("counterparty"), F.timestamp_seconds(F.lit(1704067200) + seconds).alias("time"), F.round(F.exp(5 + normal), 2).alias("amount"),
        (u("f") < 0.08).alias("failed"), (u("r") < 0.03).alias("refund"), F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.floor(u("c") * 5).cast("int") + 1).alias("category"),
        (u("i") < 0.05).alias("foreign"), (u("n") < 0.4).alias("absent"), F.col("day"),
    )
