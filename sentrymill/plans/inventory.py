"""Single primitives of the inventory as queries of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import shrunk
from ..operators import daily, decide, payers, sequences
from ..operators.cohorts import vintage
from ..operators.daily import trailing
from ..operators.histograms import LOG_BINS, log_bin
from ..sources import readers
from .behaviour import grid
from .decisions import _ACT, _COST, _PAID, _S, _TTD, _detected, decided, scored, t
from .features import _LOGBIN, EARLIER, EV, GRID, SQL as FEATURE_SQL, events, frame, panel, rounded

OUT: dict = {}
SQL: dict = {}
UTC = dt.timezone.utc


def query(sql=None):
    def add(f):
        OUT[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {GRID} SELECT entity, day, CAST(sum(n) {frame(7)} AS BIGINT) AS n7, CAST(sum(n) {frame(28)} AS BIGINT) AS n28 FROM grid")
def win_trailing(spark, sf):
    return grid(spark, sf).select("entity", "day", F.sum("n").over(trailing(7)).alias("n7"), F.sum("n").over(trailing(28)).alias("n28"))


@query(f"WITH {GRID} SELECT entity, day, round(CAST(sum(CASE WHEN early THEN n ELSE 0 END) OVER (PARTITION BY entity) AS DOUBLE) / 7, 6) AS mean FROM grid")
def win_warmup(spark, sf):
    """Baseline over the first seven calendar days; the denominator is seven whatever happened."""
    mean, _ = daily.baseline(F.col("n").cast("double"), 7)
    return rounded(grid(spark, sf).select("entity", "day", mean.alias("mean")), "mean")


@query(f"WITH {GRID} SELECT entity, day, coalesce(day - max(CASE WHEN n > 0 THEN day END) {EARLIER}, 0) AS gap, round(coalesce(max(largest) {EARLIER}, 0.0), 6) AS before FROM grid")
def win_prev_active(spark, sf):
    """Days since the last active day before this one, and the largest amount until then."""
    earlier = Window.partitionBy("entity").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col("day") - F.max(F.when(F.col("n") > 0, F.col("day"))).over(earlier), F.lit(0))
    return rounded(grid(spark, sf).select("entity", "day", gap.alias("gap"), F.coalesce(F.max("largest").over(earlier), F.lit(0.0)).alias("before")), "before")


@query(f"WITH {EV} SELECT event_id, round((epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY entity ORDER BY t, event_id)) / 1e6, 3) AS gap FROM ev")
def win_interarrival(spark, sf):
    order = Window.partitionBy("entity").orderBy("time", "event_id")
    at = F.unix_micros("time")
    return events(spark, sf).select("event_id", F.round((at - F.lag(at).over(order)) / 1e6, 3).alias("gap"))


@query("SELECT a.c_custkey, round((SELECT median(b.c_acctbal) FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey <> a.c_custkey), 4) AS loo FROM customer a")
def win_loo_median(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(sequences.leave_one_out_median(c, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_custkey", "loo"), "loo", digits=4)


@query(f"WITH {GRID}, p AS (SELECT entity, day, n, lag(n) OVER (PARTITION BY entity ORDER BY day) AS was FROM grid) SELECT entity, min(CASE WHEN was <= 3 AND n > 3 THEN day END) AS first_busy FROM p GROUP BY 1")
def win_first_transition(spark, sf):
    was = F.lag("n").over(Window.partitionBy("entity").orderBy("day"))
    return grid(spark, sf).withColumn("was", was).groupBy("entity").agg(F.min(F.when((F.col("was") <= 3) & (F.col("n") > 3), F.col("day"))).alias("first_busy"))


@query("SELECT c_custkey, CAST((c_custkey % 80 >= 6) AS INT) + CAST((c_custkey % 80 >= 24) AS INT) + CAST((c_custkey % 80 >= 60) AS INT) AS bucket FROM customer")
def coh_vintage(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", vintage(F.col("c_custkey") % 80).alias("bucket"))


@query("WITH g AS (SELECT avg(c_acctbal) AS m, avg(c_acctbal * c_acctbal) AS q FROM customer), n AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, avg(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1), s AS (SELECT c_nationkey, (n.n * n.m + 30.0 * g.m) / (n.n + 30.0) AS m, (n.n * n.q + 30.0 * g.q) / (n.n + 30.0) AS q FROM n, g) SELECT c_custkey, round((c_acctbal - m) / sqrt(greatest(q - m * m, 1e-9)), 6) + 0.0 AS z FROM customer JOIN s USING (c_nationkey)")
def coh_shrunk_z(spark, sf):
    """z by peer moments, both shrunk towards those of all."""
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    x = F.col("c_acctbal")
    gm, gq = c.agg(F.avg(x), F.avg(x * x)).first()
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.avg(x * x).alias("q"))
    per = per.select("c_nationkey", shrunk(F.col("m"), F.col("n"), F.lit(gm)).alias("m"), shrunk(F.col("q"), F.col("n"), F.lit(gq)).alias("q"))
    z = (x - F.col("m")) / F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-9)))
    return rounded(c.join(per, "c_nationkey").select("c_custkey", z.alias("z")), "z")


@query("SELECT DISTINCT o_custkey, CAST('0x' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS half FROM orders")
def spl_calfold(spark, sf):
    """Entities, not rows, are dealt to two halves."""
    half = F.conv(F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 2
    return t(spark, sf, "orders").select("o_custkey").distinct().withColumn("half", half)


@query(f"WITH {_S}, {_ACT} SELECT day, CAST(floor(sum(exposure) / 100000) AS INT) AS slots, count(*) FILTER (action = 'REVIEW') AS used FROM d GROUP BY 1")
def dec_capacity(spark, sf):
    """Review slots a day's budget pays for, and how many were used."""
    return decided(spark, sf).groupBy("day").agg(F.floor(F.sum("exposure") / 100_000).cast("int").alias("slots"), F.count_if(F.col("action") == "REVIEW").alias("used"))


@query(f"WITH {_S} SELECT CAST(h AS DOUBLE) AS false_hold, count(*) FILTER (250.0 + (1-p)*h < p*exposure AND 250.0 + (1-p)*h < 250.0 + 0.2*p*exposure) AS holds FROM s, (VALUES (500.0), (2000.0), (8000.0), (32000.0)) AS q(h) GROUP BY h")
def dec_g2_sweep(spark, sf):
    """How many rows would be held at several false-hold costs, all counted in one pass."""
    p, e = F.col("p"), F.col("exposure")
    held = lambda h: F.count_if((250.0 + (1 - p) * h < p * e) & (250.0 + (1 - p) * h < 250.0 + 0.2 * p * e))
    wide = scored(spark, sf).agg(F.array(*[F.struct(F.lit(h).alias("false_hold"), held(h).alias("holds")) for h in (500.0, 2000.0, 8000.0, 32000.0)]).alias("a"))
    return wide.select(F.inline("a"))


@query(f"WITH {_S}, o AS (SELECT entity, min(day) AS onset FROM s WHERE bad GROUP BY 1) SELECT id, CAST(onset IS NOT NULL AND day >= onset AS INT) AS y FROM s LEFT JOIN o USING (entity)")
def met_day_label(spark, sf):
    """Rows before an entity's onset are negatives, those of entities without one too."""
    s = scored(spark, sf)
    onset = s.filter("bad").groupBy("entity").agg(F.min("day").alias("onset"))
    return s.join(onset, "entity", "left").select("id", F.coalesce(F.col("day") >= F.col("onset"), F.lit(False)).cast("int").alias("y"))


@query(f"WITH {_S}, {_ACT} SELECT id, round({_PAID}, 4) + 0.0 AS cost FROM d")
def met_row_cost(spark, sf):
    d = decided(spark, sf)
    return rounded(d.select("id", decide.realised_cost(F.col("action"), F.col("bad"), F.col("loss")).alias("cost")), "cost", digits=4)


@query(f"WITH {_S}, {_ACT}, tot AS (SELECT sum({_PAID}) AS cost, sum(CASE WHEN bad THEN loss ELSE 0.0 END) AS passed, sum(CASE WHEN bad THEN 250.0 ELSE 8250.0 END) AS held FROM d) SELECT round((least(passed, held) - cost) / least(passed, held), 6) AS savings FROM tot")
def met_savings_g2(spark, sf):
    """Savings against the cheaper of passing all and holding all."""
    cost = lambda a: F.sum(decide.realised_cost(a, F.col("bad"), F.col("loss")))
    tot = decided(spark, sf).agg(cost(F.col("action")).alias("cost"), cost(F.lit("PASS")).alias("passed"), cost(F.lit("HOLD")).alias("held"))
    floor = F.least("passed", "held")
    return rounded(tot.select(((floor - F.col("cost")) / floor).alias("savings")), "savings")


@query(f"WITH {_S}, {_ACT}, m AS (SELECT day, count(*) FILTER (action <> 'PASS') AS m FROM d GROUP BY 1) SELECT round(sum(m) / count(*), 6) AS alerts_per_day, max(m) AS most FROM m")
def met_alerts(spark, sf):
    """Alerts a day on average and at most; the most never exceeds capacity."""
    per = decided(spark, sf).groupBy("day").agg(F.count_if(F.col("action") != "PASS").alias("m"))
    return rounded(per.agg((F.sum("m") / F.count(F.lit(1))).alias("alerts_per_day"), F.max("m").alias("most")), "alerts_per_day")


@query(f"WITH {_TTD} SELECT round(median(ttd), 6) AS lag, round(count(ttd) / count(*), 6) AS flagged FROM ttd")
def met_lag(spark, sf):
    """Median days from onset to flag among those flagged, and their share."""
    return rounded(_detected(spark, sf).agg(F.percentile("ttd", 0.5).alias("lag"), (F.count("ttd") / F.count(F.lit(1))).alias("flagged")), "lag", "flagged")


@query(f"WITH {_S}, {_ACT}, x AS (SELECT 1 - sum({_PAID}) / sum(CASE WHEN bad THEN loss ELSE 0.0 END) AS savings, 1 - sum(CASE WHEN bad THEN 250.0 ELSE 0.0 END) / sum(CASE WHEN bad THEN loss ELSE 0.0 END) AS ceiling FROM d) SELECT round((ceiling - savings) / ceiling, 6) AS gap FROM x")
def orc_gap(spark, sf):
    """How far savings are from hindsight without a capacity; a negative gap would be a leak and raises."""
    d = decided(spark, sf)
    lost = F.sum(F.when(F.col("bad"), F.col("loss")).otherwise(0.0))
    x = d.agg((1 - F.sum(decide.realised_cost(F.col("action"), F.col("bad"), F.col("loss"))) / lost).alias("s"), (1 - F.sum(F.when(F.col("bad"), 250.0).otherwise(0.0)) / lost).alias("c"))
    gap = F.when(F.col("s") > F.col("c") + 1e-9, F.raise_error(F.lit("savings above hindsight"))).otherwise((F.col("c") - F.col("s")) / F.col("c"))
    return rounded(x.select(gap.alias("gap")), "gap")


@query(f"WITH {_S}, c AS ({_COST}) SELECT id, CASE WHEN NOT bad THEN 'PASS' WHEN 250.0 <= 250.0 + 0.2*loss AND 250.0 < loss THEN 'HOLD' WHEN 250.0 + 0.2*loss < loss THEN 'REVIEW' ELSE 'PASS' END AS action FROM c")
def orc_g2(spark, sf):
    """Hindsight argmin of realised cost."""
    costs = {a: decide.realised_cost(F.lit(a), F.col("bad"), F.col("loss")) for a in ("PASS", "HOLD", "REVIEW")}
    each = F.array(*costs.values())
    return scored(spark, sf).select("id", F.element_at(F.array(*map(F.lit, costs)), F.array_position(each, F.array_min(each)).cast("int")).alias("action"))


@query(f"WITH {EV}, kept AS (SELECT * FROM ev WHERE NOT refund AND counterparty IS NOT NULL AND t <= TIMESTAMP '2024-01-20 12:00:00') SELECT entity, day, counterparty, count(*) AS txn_count, round(sum(amount), 6) AS value_sum FROM kept GROUP BY 1, 2, 3")
def agg_capsule_asof(spark, sf):
    seen = readers.events_as_of(events(spark, sf), "time", dt.datetime(2024, 1, 20, 12, tzinfo=UTC))
    return rounded(payers.capsules(seen).select("entity", "day", "counterparty", "txn_count", "value_sum"), "value_sum")


@query(f"WITH {EV} SELECT entity, {_LOGBIN} AS bin, count(*) AS k FROM ev GROUP BY 1, 2")
def agg_hist(spark, sf):
    """Histogram as a dense vector of fixed width, unrolled to its filled bins."""
    per = events(spark, sf).withColumn("bin", log_bin(F.col("amount"))).groupBy("entity").agg(F.array(*[F.count_if(F.col("bin") == b) for b in range(LOG_BINS)]).alias("h"))
    return per.select("entity", F.posexplode("h").alias("bin", "k")).filter("k > 0")


@query(f"WITH {GRID}, z AS (SELECT day, {FEATURE_SQL['v_txn_count_z']} AS z FROM grid) SELECT day, round(avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM z GROUP BY 1")
def gat_alert_rate(spark, sf):
    return rounded(panel(spark, sf).groupBy("day").agg(F.avg((F.col("v_txn_count_z") > 2).cast("double")).alias("rate")), "rate")


@query(f"WITH {GRID} SELECT entity, day, n - refunds AS n FROM grid")
def gat_daily_counts(spark, sf):
    return grid(spark, sf).select("entity", "day", (F.col("n") - F.col("refunds")).alias("n"))


@query(f"WITH {_S}, a AS (SELECT stratum, bad, p, row_number() OVER (PARTITION BY stratum ORDER BY p DESC, id) AS k FROM s) SELECT stratum, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM a WHERE k <= 50 GROUP BY 1")
def scr_recall_p(spark, sf):
    """Share of bad rows among the fifty best of each class."""
    k = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("p"), "id"))
    return rounded(scored(spark, sf).withColumn("k", k).filter("k <= 50").groupBy("stratum").agg(F.avg(F.col("bad").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")), "rate")


@query(f"WITH {_S}, {_ACT}, arms AS (SELECT stratum AS policy, 'hold' AS arm, sum({_PAID}) AS cost FROM d GROUP BY 1 UNION ALL SELECT stratum, 'review_only', sum(CASE action WHEN 'PASS' THEN CASE WHEN bad THEN loss ELSE 0.0 END ELSE CASE WHEN bad THEN 250.0 + 0.2*loss ELSE 250.0 END END) FROM d GROUP BY 1) SELECT policy, arm, round(cost, 2) AS cost FROM arms")
def scr_sweep_arms(spark, sf):
    """Cost per policy with holds and with reviews alone, both from one aggregate."""
    cost = lambda a: F.sum(decide.realised_cost(a, F.col("bad"), F.col("loss")))
    alone = F.when(F.col("action") == "PASS", "PASS").otherwise("REVIEW")
    per = decided(spark, sf).groupBy(F.col("stratum").alias("policy")).agg(cost(F.col("action")).alias("hold"), cost(alone).alias("review_only"))
    return rounded(per.unpivot("policy", ["hold", "review_only"], "arm", "cost"), "cost", digits=2)


def queries():
    return OUT


def oracle_sql():
    return SQL
