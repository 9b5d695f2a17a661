"""The shared day roll and the features read from it.

One aggregate by (entity, day) feeds every feature; the calendar grid gives empty days rows of
zeros, and each trailing quantity is a RANGE frame over the day number. All days come at once:
two shuffles by entity, whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUND_AMOUNTS = (100.0, 500.0, 1000.0, 5000.0)
ZERO, CLIP, FLOOR = 0.0, 50.0, 1e-9


def captured(failed: Column, refund: Column) -> Column:
    return ~failed & ~refund


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den isn't positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def day_roll(events: DataFrame) -> DataFrame:
    """(entity, day) with counts and sums of every numerator; events under role names."""
    keep = captured(F.col("failed"), F.col("refund"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    hit = F.lit(False)
    for r in ROUND_AMOUNTS:
        hit = hit | (F.abs(F.col("amount") - r) < 0.005)
    return events.groupBy("entity", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(keep, F.col("amount")).otherwise(0.0)).alias("gmv"),
        one(F.col("failed")).alias("failures"),
        one(F.col("refund")).alias("refunds"),
        F.sum(F.when(F.col("refund"), F.col("amount")).otherwise(0.0)).alias("refunded"),
        one(hit).alias("round_hits"),
        one(F.col("amount") <= 10).alias("micro"),
        one(F.col("foreign")).alias("foreign_n"),
        one(F.col("absent")).alias("absent_n"),
        F.max(F.when(keep, F.col("amount"))).alias("largest"),
    )


ADDITIVE = ("n", "gmv", "failures", "refunds", "refunded", "round_hits", "micro", "foreign_n", "absent_n")


def last_day(events: DataFrame) -> int | None:
    """The table's last day, from one column of the scan."""
    return events.agg(F.max("day")).first()[0]


def grid(rolled: DataFrame, until: int | None = None) -> DataFrame:
    """Every day from an entity's first to `until` (by default the table's last), zeros where nothing happened.

    Each active day brings the empty days up to the next one with it, so the calendar costs no
    join: one shuffle by entity serves the gaps and every frame read from the grid.
    """
    until = last_day(rolled) if until is None else until
    order = Window.partitionBy("entity").orderBy("day")
    upto = F.coalesce(F.lead("day").over(order) - 1, F.greatest(F.col("day"), F.lit(0 if until is None else until)))
    spread = rolled.filter(F.col("day") <= F.lit(0 if until is None else until)).withColumns({"anchor": F.min("day").over(order), "__to": upto})
    spread = spread.withColumn("__day", F.explode(F.sequence("day", "__to")))
    here = F.col("__day") == F.col("day")
    return spread.select("entity", F.col("__day").alias("day"), "anchor", *[F.when(here, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ADDITIVE], F.when(here, F.col("largest")).alias("largest"))


def by_entity() -> Window:
    return Window.partitionBy("entity")


def trailing(days: int, back: int = 0) -> Window:
    """Calendar days day-back-days+1 .. day-back."""
    return Window.partitionBy("entity").orderBy("day").rangeBetween(-(days - 1) - back, -back)


def clipped(x: Column, bound: float = CLIP) -> Column:
    return F.least(F.lit(bound), F.greatest(F.lit(-bound), x))


def baseline(x: Column, warmup: int) -> tuple[Column, Column]:
    """Mean and population deviation over the first warmup calendar days; the denominator is warmup."""
    early = F.col("day") - F.col("anchor") < warmup
    s = F.sum(F.when(early, x).otherwise(0.0)).over(by_entity())
    ss = F.sum(F.when(early, x * x).otherwise(0.0)).over(by_entity())
    mean = s / warmup
    return mean, F.sqrt(F.greatest(ss / warmup - mean * mean, F.lit(0.0)))


def elapsed(warmup: int) -> Column:
    return F.col("day") - F.col("anchor") >= warmup


def z_score(x: Column, warmup: int) -> Column:
    mean, sd = baseline(x, warmup)
    return F.when(elapsed(warmup), clipped((x - mean) / F.greatest(sd, F.lit(FLOOR)))).otherwise(0.0)


def add_features(panel: DataFrame, warmup: int) -> DataFrame:
    """The day-grid features of the register; columns are added to the grid's."""
    n, gmv = F.col("n").cast("double"), F.col("gmv")
    mean_gmv, _ = baseline(gmv, warmup)
    a, b, c = (F.sum("gmv").over(trailing(7, k)) for k in (0, 7, 14))
    b, c = F.coalesce(b, F.lit(0.0)), F.coalesce(c, F.lit(0.0))
    m1 = F.sum("n").over(trailing(28)) / F.lit(28.0)
    m2 = F.sum(n * n).over(trailing(28)) / F.lit(28.0)
    earlier = Window.partitionBy("entity").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    last_active = F.max(F.when(F.col("n") > 0, F.col("day"))).over(earlier)
    hist_max = F.max("largest").over(earlier)
    weekend = F.pmod(F.col("day"), F.lit(7)) >= 5  # the origin is a Monday
    weekend_7 = F.sum(F.when(weekend, gmv).otherwise(0.0)).over(trailing(7))
    early = F.col("day") - F.col("anchor") < warmup
    early_gmv = F.sum(F.when(early, gmv).otherwise(0.0)).over(by_entity())
    early_weekend = F.sum(F.when(early & weekend, gmv).otherwise(0.0)).over(by_entity())
    p0 = ratio(early_weekend, early_gmv)
    share_7 = ratio(weekend_7, F.sum("gmv").over(trailing(7)))
    count_z = z_score(n, warmup)
    return panel.withColumns(
        {
            "v_txn_count_z": count_z,
            "v_gmv_z": z_score(gmv, warmup),
            "v_gmv_accel": F.when(elapsed(warmup), (a - 2 * b + c) / F.greatest(7 * mean_gmv, F.lit(1.0))).otherwise(0.0),
            "gmv_30": F.sum("gmv").over(trailing(30)),
            "v_fano_trailing": F.when(m1 > 0, F.greatest(m2 - m1 * m1, F.lit(0.0)) / m1).otherwise(0.0),
            "v_dormant_burst": F.coalesce(F.col("day") - last_active, F.lit(0)) * count_z,
            "t_round_amount_share": ratio(F.col("round_hits"), F.col("n")),
            "t_micro_share": ratio(F.col("micro"), F.col("n")),
            "t_new_max_event": F.when((hist_max > 0) & (F.col("largest") > 3 * hist_max), 1.0).otherwise(0.0),
            "i_intl_share": ratio(F.col("foreign_n"), F.col("n")),
            "i_cnp_share": ratio(F.col("absent_n"), F.col("n")),
            "f_auth_fail_rate_z": z_score(ratio(F.col("failures"), F.col("n")), warmup),
            "d_refund_rate_z": z_score(ratio(F.col("refunds"), F.col("n")), warmup),
            "d_refund_amount_ratio": ratio(F.sum("refunded").over(trailing(7)), F.sum("gmv").over(trailing(7))),
            "h_weekend_share_z": F.when(elapsed(warmup), clipped((share_7 - p0) / F.greatest(F.sqrt(p0 * (1 - p0) / 7), F.lit(FLOOR)))).otherwise(0.0),
        }
    )


def interarrival_cv(events: DataFrame, panel: DataFrame) -> DataFrame:
    """(entity, day, h_interarrival_cv): population CV of gaps in the trailing seven days, 0 with fewer than two."""
    order = Window.partitionBy("entity").orderBy("time", "event_id")
    gap = (F.unix_micros("time") - F.lag(F.unix_micros("time")).over(order)) / F.lit(1e6)
    per = events.withColumn("gap", gap).filter("gap is not null").groupBy("entity", "day").agg(F.count(F.lit(1)).alias("k"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("ss"))
    joined = panel.select("entity", "day").join(per, ["entity", "day"], "left").fillna(0)
    k, s, ss = (F.sum(c).over(trailing(7)) for c in ("k", "s", "ss"))
    mean = s / k
    cv = F.when((k >= 2) & (s > 0), F.sqrt(F.greatest(ss / k - mean * mean, F.lit(0.0))) / mean).otherwise(0.0)
    return joined.select("entity", "day", cv.alias("h_interarrival_cv"))


def retry_bursts(events: DataFrame, within_s: int = 600, back: int = 8, least: int = 2) -> DataFrame:
    """(entity, day, f_retry_burst_rate): share of events with at least `least` of the entity's previous `back` by the same counterparty in time."""
    order = Window.partitionBy("entity").orderBy("time", "event_id")
    same = F.lit(0)
    for k in range(1, back + 1):
        near = (F.lag("counterparty", k).over(order) == F.col("counterparty")) & (F.unix_micros("time") - F.lag(F.unix_micros("time"), k).over(order) <= within_s * 1_000_000)
        same = same + F.when(near, 1).otherwise(0)
    return events.withColumn("burst", same >= least).groupBy("entity", "day").agg(F.avg(F.col("burst").cast("double")).alias("f_retry_burst_rate"))


def days_since(onboarded: Column, as_of: Column) -> Column:
    """Whole days from onboarding to the day as_of, which counts on through days without events; 0 where onboarding is unknown."""
    return F.coalesce(F.datediff(as_of.cast("date"), onboarded.cast("date")), F.lit(0))
