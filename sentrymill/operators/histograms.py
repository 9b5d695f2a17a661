"""Per-entity histograms as fixed-width array columns: quantiles, divergences, entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .daily import by_entity, captured, day_roll, grid, last_day, trailing

LOG_BINS, DECADES = 32, 7
CATEGORIES = ("click", "error", "purchase", "signup", "view")


def log_bin(amount: Column) -> Column:
    """32 bins of log10 over [0, 7], amounts under 1 in the first."""
    return F.least(F.lit(LOG_BINS - 1), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(amount, F.lit(1.0))) / DECADES * LOG_BINS))).cast("int")


def quantile_ratio(events: DataFrame, high: float, low: float) -> DataFrame:
    """(entity, t_p95_median_ratio) from the whole-history histogram of captured amounts, by bin midpoints."""
    cells = events.filter(captured(F.col("failed"), F.col("refund"))).groupBy("entity", log_bin(F.col("amount")).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    run = cells.withColumn("cum", F.sum("k").over(Window.partitionBy("entity").orderBy("b"))).withColumn("total", F.sum("k").over(by_entity()))
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("b")))
    return run.groupBy("entity").agg(F.pow(F.lit(10.0), (at(high) - at(low)) * DECADES / LOG_BINS).alias("t_p95_median_ratio"))


BUCKETS = {
    "amount": (LOG_BINS, lambda: log_bin(F.col("amount")), lambda: captured(F.col("failed"), F.col("refund"))),
    "category": (len(CATEGORIES), lambda: F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int") - 1, lambda: F.lit(True)),
    "hour": (24, lambda: F.hour("time"), lambda: F.lit(True)),
}


def _shares(x: Column, total: Column) -> Column:
    return F.transform(x, lambda v: F.when(total > 0, v / total).otherwise(F.lit(0.0)))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def jensen_shannon_bits(p: Column, q: Column) -> Column:
    part = lambda a, b: F.when(a > 0, 0.5 * a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))))


def wasserstein(p: Column, q: Column, step: float) -> Column:
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("sum"))
    fold = lambda a, d: F.struct((a["gap"] + d).alias("gap"), (a["sum"] + F.abs(a["gap"] + d)).alias("sum"))
    return F.aggregate(F.zip_with(p, q, lambda a, b: a - b), start, fold, lambda a: a["sum"] * step)


def trailing_divergence(events: DataFrame, kind: str, warmup: int, days: int = 7) -> DataFrame:
    """(entity, day, value): the trailing days' histogram against the warm-up's; 0 without mass in both or before warm-up.

    One pivoted row per (entity, day) with a column per bucket, then one window sort by entity.
    """
    n, bucket, keep = BUCKETS[kind]
    cells = events.filter(keep()).withColumn("b", bucket()).groupBy("entity", "day").agg(*[F.sum((F.col("b") == k).cast("int")).alias(f"b{k}") for k in range(n)])
    days_of = grid(day_roll(events), last_day(events)).select("entity", "day", "anchor").join(cells, ["entity", "day"], "left").fillna(0)
    recent = F.array(*[F.sum(f"b{k}").over(trailing(days)).cast("double") for k in range(n)])
    early = F.col("day") - F.col("anchor") < warmup
    base = F.array(*[F.sum(F.when(early, F.col(f"b{k}")).otherwise(0)).over(by_entity()).cast("double") for k in range(n)])
    out = days_of.select("entity", "day", "anchor", recent.alias("w"), base.alias("h"))
    out = out.withColumns({"wt": _sum(F.col("w")), "ht": _sum(F.col("h"))})
    out = out.withColumns({"p": _shares(F.col("w"), F.col("wt")), "q": _shares(F.col("h"), F.col("ht"))})
    value = wasserstein(F.col("p"), F.col("q"), DECADES / LOG_BINS) if kind == "amount" else jensen_shannon_bits(F.col("p"), F.col("q"))
    ready = (F.col("wt") > 0) & (F.col("ht") > 0) & (F.col("day") - F.col("anchor") >= warmup)
    return out.select("entity", "day", F.when(ready, value).otherwise(0.0).alias("value"))


def decline_entropy(events: DataFrame, buckets: int = 8) -> DataFrame:
    """(entity, day, f_decline_entropy): bits of failed events' counterparties over crc32 buckets."""
    cells = events.filter("failed").groupBy("entity", "day", (F.crc32(F.coalesce("counterparty", F.lit("")).cast("binary")) % buckets).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy("entity", "day"))
    return cells.withColumn("p", p).groupBy("entity", "day").agg(F.sum(-F.col("p") * F.log2("p")).alias("f_decline_entropy"))
