"""Counterparty operators: weekly graphs, capsules, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly(events: DataFrame) -> DataFrame:
    return events.withColumn("week", F.floor(F.col("day") / 7).cast("int"))


def in_intervals(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events whose day lies in one of their entity's intervals [start_day, end_day), each once."""
    e, i = events.alias("e"), intervals.alias("i")
    return e.join(i, (F.col("e.entity") == F.col("i.entity")) & (F.col("e.day") >= F.col("i.start_day")) & (F.col("e.day") < F.col("i.end_day")), "left_semi")


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with prior_id: the right event of the entity last at or before it, null if none.

    Both sides go through one sort by entity and time; no pair is made. Of right events at one
    instant the largest id counts.
    """
    both = left.select("entity", "time", "event_id", F.lit(1).alias("side")).unionByName(right.select("entity", "time", "event_id", F.lit(0).alias("side")))
    seen = Window.partitionBy("entity").orderBy("time", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    prior = F.last(F.when(F.col("side") == 0, F.col("event_id")), ignorenulls=True).over(seen)
    return both.withColumn("prior_id", prior).filter("side = 1").drop("side")


def entropy(events: DataFrame, keys: list[str], of: str) -> DataFrame:
    """keys and h: entropy in nats of column `of` within keys."""
    cells = events.groupBy(*keys, of).agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(*keys))
    return cells.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.ln("p")).alias("h"))


def capsules(events: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """(entity, day, counterparty): last time, count, value, ticket CV, failure rate, a share for each category, new-payer flag, payers of its device; refunds left out.

    device_shared_payers is the largest number of the entity's payers that share one of the
    capsule's devices. An unknown (null) device is no device: it joins nothing, and a capsule
    without a known one counts 1. Devices meet distinct cells, not events.
    """
    kept = events.filter(~F.col("refund") & F.col("counterparty").isNotNull())
    amount, n, total = F.col("amount"), F.count(F.lit(1)), F.sum("amount")
    per = kept.groupBy("entity", "day", "counterparty").agg(
        F.max("time").alias("last_event_time"),
        n.alias("txn_count"),
        total.alias("value_sum"),
        F.when(total > 0, F.coalesce(F.stddev_pop(amount), F.lit(0.0)) * n / total).otherwise(0.0).alias("ticket_cv"),
        F.avg(F.col("failed").cast("double")).alias("failure_rate"),
        *[F.avg((F.col("category") == c).cast("double")).alias(f"{c}_share") for c in categories],
    )
    cells = kept.filter("device is not null").select("entity", "day", "counterparty", "device").distinct()
    devices = cells.select("entity", "device", "counterparty").distinct().groupBy("entity", "device").agg(F.count(F.lit(1)).alias("payers"))
    shared = cells.join(devices, ["entity", "device"]).groupBy("entity", "day", "counterparty").agg(F.max("payers").alias("device_shared_payers"))
    first = F.min("day").over(Window.partitionBy("entity", "counterparty"))
    whole = per.withColumn("payer_is_new", (F.col("day") == first).cast("int")).join(shared, ["entity", "day", "counterparty"], "left")
    return whole.withColumn("device_shared_payers", F.coalesce("device_shared_payers", F.lit(1)))


def payer_graph(events: DataFrame) -> DataFrame:
    """(entity, week): payers, entropy, concentration of amounts, new and repeat shares, Jaccard with the week before.

    The cells (entity, week, counterparty) are aggregated once; overlap comes from a lag, not a self-join.
    """
    cells = weekly(events).filter("counterparty is not null").groupBy("entity", "week", "counterparty").agg(F.count(F.lit(1)).alias("k"), F.sum("amount").alias("a"))
    of_payer, of_week = Window.partitionBy("entity", "counterparty"), Window.partitionBy("entity", "week")
    cells = cells.withColumns(
        {"before": F.lag("week").over(of_payer.orderBy("week")), "first_week": F.min("week").over(of_payer), "kt": F.sum("k").over(of_week), "at": F.sum("a").over(of_week)}
    )
    p, s = F.col("k") / F.col("kt"), F.col("a") / F.col("at")
    per = cells.groupBy("entity", "week").agg(
        F.count(F.lit(1)).alias("payers"),
        F.count_if(F.col("before") == F.col("week") - 1).alias("both"),
        F.sum(-p * F.ln(p)).alias("payer_entropy"),
        F.sum(s * s).alias("payer_herfindahl"),
        (F.sum(F.when(F.col("first_week") == F.col("week"), F.col("k")).otherwise(0)) / F.max("kt")).alias("new_payer_ratio"),
        (F.count_if(F.col("first_week") < F.col("week")) / F.count(F.lit(1))).alias("repeat_payer_ratio"),
    )
    order = Window.partitionBy("entity").orderBy("week")
    was = F.when(F.lag("week").over(order) == F.col("week") - 1, F.lag("payers").over(order)).otherwise(0)
    either = F.col("payers") + was - F.col("both")
    return per.withColumn("payer_jaccard_prev", F.when(either > 0, F.col("both") / either).otherwise(0.0)).drop("both")
