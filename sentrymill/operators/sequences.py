"""Ordered operators: runs, segments, fills, ranks, recursions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Maximal runs of one state: keys, state, first, last (inclusive), n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def first_change(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Where the state first differs from the one before; null if never."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__c", F.when(before.isNotNull() & (before != F.col(state)), F.col(order))).groupBy(*keys).agg(F.min("__c").alias("first_change"))


def forward_fill(column: str, keys: list[str], order: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def rank_normalised(keys: list[str], *order: Column) -> Column:
    """Ordinal rank over n - 1; 0 for a lone row. Ties by the order given."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(n > 1, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / (n - 1)).otherwise(0.0)


def average_rank(keys: list[str], value: str) -> Column:
    """Rank with ties at their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2


def _quantiles(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(lambda x: inv(x) if 0 < x < 1 else None)


def normal_score(df: DataFrame, keys: list[str], value: str, bound: float = 4.0) -> DataFrame:
    """df with score: the normal quantile of (average rank - 1/2) / n within keys, within bounds."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumn("__p", (average_rank(keys, value) - 0.5) / n)
    return ranked.withColumn("score", F.least(F.lit(bound), F.greatest(F.lit(-bound), F.pandas_udf(_quantiles, "double")("__p")))).drop("__p")


def page_cusum(df: DataFrame, keys: list[str], order: str, x: str, drift: float = 0.25, cap: float = 20.0) -> DataFrame:
    """(keys, order, cusum): C = min(cap, max(0, C + x - drift)) along the order, from 0 for each key.

    One fold over a key's rows in order; a key has a row a day, so its array is bounded by the calendar.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x")))).alias("s"))
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<o:int,c:double>>").alias("out"))

    def step(a, r):
        c = F.least(F.lit(cap), F.greatest(F.lit(0.0), a["c"] + r["x"] - drift))
        return F.struct(c.alias("c"), F.concat(a["out"], F.array(F.struct(r["o"].cast("int").alias("o"), c.alias("c")))).alias("out"))

    folded = rows.select(*keys, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("r"))
    return folded.select(*keys, F.col("r.o").alias(order), F.col("r.c").alias("cusum"))


def run_length(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with run: rows since value was last 0, the current one included; 0 there."""
    w = Window.partitionBy(*keys).orderBy(order)
    zero = F.col(value) == 0
    grouped = df.withColumn("__g", F.sum(F.when(zero, 1).otherwise(0)).over(w))
    k = F.row_number().over(Window.partitionBy(*keys, "__g").orderBy(order))
    return grouped.withColumn("run", F.when(zero, 0).when(F.col("__g") > 0, k - 1).otherwise(k)).drop("__g")


def leave_one_out_median(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """df with loo: the median of the others in keys, null for a lone row.

    Without row r, the sorted rest's middle lies at fixed ranks that move by one past r; so four
    order statistics of the group, by rank, answer for every member.
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(value, tie))).withColumn("__n", F.count(F.lit(1)).over(w))
    m = F.col("__n") - 1
    low, high = F.floor((m + 1) / 2), F.floor((m + 2) / 2)
    at = lambda k: F.max(F.when(F.col("__r") == k, F.col(value))).over(w)
    four = ranked.withColumns({"__a": at(low), "__b": at(low + 1), "__c": at(high), "__d": at(high + 1)})
    pick = F.when(F.col("__r") <= low, F.col("__b")).otherwise(F.col("__a")) + F.when(F.col("__r") <= high, F.col("__d")).otherwise(F.col("__c"))
    return four.withColumn("loo", F.when(F.col("__n") > 1, pick / 2)).drop("__r", "__n", "__a", "__b", "__c", "__d")
