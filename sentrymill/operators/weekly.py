"""The dense seven-day panel and its standardisation with shrinkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .payers import weekly


def window_panel(events: DataFrame) -> DataFrame:
    """(entity, week) from each entity's first to the table's last week: means, velocities, ratios.

    Empty weeks carry the last log amount forward and zeros elsewhere; `sparse` marks them.
    """
    w = weekly(events)
    x = F.ln(F.greatest(F.col("amount"), F.lit(0.01)))
    per = w.groupBy("entity", "week").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("log_amount_mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("log_amount_var"), F.avg(F.col("refund").cast("double")).alias("refund_ratio"), F.percentile("amount", 0.95).alias("p95")
    )
    last = w.agg(F.max("week")).first()[0] or 0
    grid = per.groupBy("entity").agg(F.min("week").alias("w0")).select("entity", F.explode(F.sequence(F.col("w0"), F.greatest(F.col("w0"), F.lit(last)))).alias("week"))
    so_far = Window.partitionBy("entity").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(per, ["entity", "week"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "entity", "week", n.alias("n"), F.ln(1 + n / 7).alias("log_velocity"), F.last("log_amount_mean", True).over(so_far).alias("log_amount_mean"),
        F.coalesce("log_amount_var", F.lit(0.0)).alias("log_amount_var"), F.coalesce("refund_ratio", F.lit(0.0)).alias("refund_ratio"), F.coalesce("p95", F.lit(0.0)).alias("p95"), F.when(n == 0, 1.0).otherwise(0.0).alias("sparse"),
    )


def standardise(panel: DataFrame, column: str, segment: str, burn_in: int, n0: float = 4.0, bound: float = 10.0) -> DataFrame:
    """(entity, week, z): by the entity's burn-in mean, its deviation shrunk towards its segment's."""
    order = Window.partitionBy("entity").orderBy("week")
    early = panel.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= burn_in)
    own = early.groupBy("entity").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.count(F.lit(1)).alias("k"), F.first(segment).alias("__s"))
    peers = early.groupBy(F.col(segment).alias("__s")).agg(F.stddev_pop(column).alias("sd_seg"))
    scale = own.join(peers, "__s").withColumn("w", F.col("k") / (F.col("k") + n0))
    sd = F.greatest(F.col("w") * F.col("sd") + (1 - F.col("w")) * F.col("sd_seg"), F.lit(1e-9))
    z = (F.col(column) - F.col("mean")) / sd
    return panel.join(scale, "entity").select("entity", "week", F.least(F.lit(bound), F.greatest(F.lit(-bound), z)).alias("z"))
