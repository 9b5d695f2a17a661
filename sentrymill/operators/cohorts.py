"""Peer cohorts with back-off by size, and residuals from their leave-one-out medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import leave_one_out_median

EDGES = (6, 24, 60)


def vintage(months: Column) -> Column:
    """How many edges are at most months."""
    return sum((F.when(months >= e, 1).otherwise(0) for e in EDGES), F.lit(0))


def deciles(df: DataFrame, value: str) -> DataFrame:
    """df with decile: how many of nine interpolated quantile cuts are at most value. The cuts are nine numbers on the driver."""
    cuts = df.agg(F.percentile(value, F.array(*[F.lit(k / 10) for k in range(1, 10)]))).first()[0] or []
    return df.withColumn("decile", sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def assign(profiles: DataFrame, group: str, value: str, months: str, least: int = 30) -> DataFrame:
    """profiles with cohort and level: full key, else group, else global, where the finer has fewer than least members."""
    keyed = deciles(profiles, value).withColumn("__full", F.concat_ws("|", F.col(group).cast("string"), F.col("decile"), vintage(F.col(months))))
    size = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    keyed = keyed.withColumns({"__nf": size("__full"), "__ng": size(group)})
    level = F.when(F.col("__nf") >= least, "full").when(F.col("__ng") >= least, "group").otherwise("global")
    cohort = F.when(level == "full", F.col("__full")).when(level == "group", F.col(group).cast("string")).otherwise("global")
    return keyed.withColumn("level", level).withColumn("cohort", cohort).drop("__full", "__nf", "__ng", "decile")


def residuals(panel: DataFrame, cohorts: DataFrame, value: str) -> DataFrame:
    """(entity, day, residual): value less the leave-one-out median of the entity's cohort that day; that median is 0 for one alone."""
    joined = panel.join(cohorts.select("entity", "cohort"), "entity")
    out = leave_one_out_median(joined, ["day", "cohort"], value, "entity")
    return out.select("entity", "day", (F.col(value) - F.coalesce(F.col("loo"), F.lit(0.0))).alias("residual"))
