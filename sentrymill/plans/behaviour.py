"""Windows, ranks, cohorts, weekly panels, sequences and gate statistics as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cohorts, daily, sequences, weekly
from .features import EV, GRID, SQL as FEATURE_SQL, events, frame, panel, rounded

OUT: dict = {}
SQL: dict = {}


def query(sql=None):
    def add(f):
        OUT[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def grid(spark, sf):
    return daily.grid(daily.day_roll(events(spark, sf)), daily.last_day(events(spark, sf)))


_COHORT = """cut AS (SELECT quantile_cont(c_acctbal, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM customer),
prof AS (SELECT c_custkey AS entity, c_mktsegment AS grp, c_acctbal AS v, c_custkey % 80 AS months, len(list_filter(q, lambda x: x <= c_acctbal)) AS decile FROM customer, cut),
full_ AS (SELECT *, grp || '|' || decile || '|' || (CAST(months >= 6 AS INT) + CAST(months >= 24 AS INT) + CAST(months >= 60 AS INT)) AS fk FROM prof),
sized AS (SELECT *, count(*) OVER (PARTITION BY fk) AS nf, count(*) OVER (PARTITION BY grp) AS ng FROM full_),
coh AS (SELECT entity, CASE WHEN nf >= 5 THEN 'full' WHEN ng >= 5 THEN 'group' ELSE 'global' END AS level, CASE WHEN nf >= 5 THEN fk WHEN ng >= 5 THEN grp ELSE 'global' END AS cohort FROM sized)"""


def profile_cohorts(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    profiles = c.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 80).alias("months"))
    return cohorts.assign(profiles, "grp", "v", "months", least=5)


@query(f"WITH {_COHORT} SELECT entity, level, cohort FROM coh")
def coh_assign(spark, sf):
    return profile_cohorts(spark, sf).select("entity", "level", "cohort")


@query(f"WITH {_COHORT} SELECT level, count(*) AS n FROM coh GROUP BY 1")
def coh_counts(spark, sf):
    return profile_cohorts(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_Z = f"z AS (SELECT entity, day, {FEATURE_SQL['v_txn_count_z']} AS z FROM grid)"
_SEG = "m AS (SELECT entity, day, z, c_mktsegment AS cohort FROM z JOIN customer ON c_custkey = entity)"


@query(f"WITH {GRID}, {_Z}, {_SEG} SELECT a.entity, a.day, round(a.z - coalesce((SELECT median(b.z) FROM m b WHERE b.day = a.day AND b.cohort = a.cohort AND b.entity <> a.entity), 0.0), 6) + 0.0 AS residual FROM m a")
def coh_residuals(spark, sf):
    """Leave-one-out residual of the count z within market segment and day."""
    z = panel(spark, sf).select("entity", "day", F.col("v_txn_count_z").alias("z"))
    peers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("cohort"))
    return rounded(cohorts.residuals(z, peers, "z"), "residual")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def win_topk_day(spark, sf):
    """Top three a day; the rank filter over a window keeps only the head of each partition before the shuffle."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders.withColumn("r", rank).filter("r <= 3").select("o_orderkey")


@query("SELECT c_custkey, round(CASE WHEN count(*) OVER (PARTITION BY c_nationkey) > 1 THEN (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER (PARTITION BY c_nationkey) - 1) ELSE 0.0 END, 6) AS r FROM customer")
def win_rank_norm(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", F.round(sequences.rank_normalised(["c_nationkey"], F.col("c_acctbal"), F.col("c_custkey")), 6).alias("r"))


@query()
def win_normal_score(spark, sf):
    """Normal quantiles have no SQL in the second engine."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(sequences.normal_score(c, ["c_nationkey"], "c_acctbal"), "score").select("c_custkey", "score")


_STEPS = f"WITH RECURSIVE {GRID}, x AS (SELECT entity, day, CAST(n AS DOUBLE) / 2 AS x, row_number() OVER (PARTITION BY entity ORDER BY day) AS k FROM grid), c AS (SELECT entity, day, k, least(20.0, greatest(0.0, x - 0.25)) AS cusum FROM x WHERE k = 1 UNION ALL SELECT x.entity, x.day, x.k, least(20.0, greatest(0.0, c.cusum + x.x - 0.25)) FROM x JOIN c ON x.entity = c.entity AND x.k = c.k + 1)"


@query(_STEPS + " SELECT entity, day, round(cusum, 6) + 0.0 AS cusum FROM c")
def win_page_cusum(spark, sf):
    x = grid(spark, sf).select("entity", F.col("day").cast("int").alias("day"), (F.col("n") / 2).alias("x"))
    return rounded(sequences.page_cusum(x, ["entity"], "day", "x"), "cusum")


@query(f"WITH {GRID}, g AS (SELECT entity, day, n, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY day) AS g FROM grid) SELECT entity, day, CASE WHEN n = 0 THEN 0 WHEN g > 0 THEN row_number() OVER (PARTITION BY entity, g ORDER BY day) - 1 ELSE row_number() OVER (PARTITION BY entity, g ORDER BY day) END AS run FROM g")
def win_run_length(spark, sf):
    return sequences.run_length(grid(spark, sf).select("entity", "day", "n"), ["entity"], "day", "n").select("entity", "day", "run")


_STATE = "s AS (SELECT entity, day, CASE WHEN n = 0 THEN 'QUIET' WHEN n <= 3 THEN 'NORMAL' ELSE 'BUSY' END AS state FROM grid)"


def states(spark, sf):
    n = F.col("n")
    return grid(spark, sf).select("entity", "day", F.when(n == 0, "QUIET").when(n <= 3, "NORMAL").otherwise("BUSY").alias("state"))


@query(f"WITH {GRID}, {_STATE}, r AS (SELECT *, day - row_number() OVER (PARTITION BY entity, state ORDER BY day) AS g FROM s) SELECT entity, state, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY entity, state, g")
def win_segments(spark, sf):
    return sequences.segments(states(spark, sf), ["entity"], "day", "state")


@query(f"WITH {GRID}, {_STATE}, r AS (SELECT *, day - row_number() OVER (PARTITION BY entity, state ORDER BY day) AS g FROM s) SELECT entity, state, min(day) AS start_day, max(day) + 1 AS end_day FROM r GROUP BY entity, state, g")
def win_rle(spark, sf):
    """Intervals with an exclusive end, as the interval join reads them."""
    runs = sequences.segments(states(spark, sf), ["entity"], "day", "state")
    return runs.select("entity", "state", F.col("first").alias("start_day"), (F.col("last") + 1).alias("end_day"))


@query(f"WITH {GRID}, {_STATE}, p AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY day) AS was FROM s) SELECT entity, min(CASE WHEN was IS NOT NULL AND was <> state THEN day END) AS first_change FROM p GROUP BY 1")
def win_first_change(spark, sf):
    return sequences.first_change(states(spark, sf), ["entity"], "day", "state")


@query(f"WITH {GRID}, {_Z} SELECT entity, min(CASE WHEN round(z, 6) > 2 THEN day END) AS first_alert FROM z GROUP BY 1")
def win_first_alert(spark, sf):
    return panel(spark, sf).groupBy("entity").agg(F.min(F.when(F.round("v_txn_count_z", 6) > 2, F.col("day"))).alias("first_alert"))


@query(f"WITH {GRID} SELECT entity, day, round(coalesce(last_value(largest IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS carried FROM grid")
def win_ffill(spark, sf):
    return grid(spark, sf).select("entity", "day", F.round(F.coalesce(sequences.forward_fill("largest", ["entity"], "day"), F.lit(0.0)), 6).alias("carried"))


@query(f"WITH {GRID} SELECT entity, day, CAST(sum(n) {frame(7)} AS BIGINT) AS n7, round(coalesce(sum(n) {frame(14, 7)}, 0) / 2.0, 6) AS base FROM grid")
def win_cum_trailing(spark, sf):
    """Seven trailing days against half of the fourteen before."""
    n7, base = F.sum("n").over(daily.trailing(7)), F.coalesce(F.sum("n").over(daily.trailing(14, 7)), F.lit(0))
    return grid(spark, sf).select("entity", "day", n7.alias("n7"), F.round(base / 2, 6).alias("base"))


@query(f"WITH {EV}, f AS (SELECT entity, counterparty, min(t) AS first_time, min(day) AS first_day FROM ev GROUP BY 1, 2) SELECT entity, counterparty, epoch_us(first_time) AS first_us, first_day FROM f")
def win_first_seen(spark, sf):
    return events(spark, sf).groupBy("entity", "counterparty").agg(F.unix_micros(F.min("time")).alias("first_us"), F.min("day").alias("first_day"))


_WEEK = f"""WITH {EV}, w AS (SELECT *, CAST(floor(day / 7.0) AS INT) AS week, ln(greatest(amount, 0.01)) AS x FROM ev),
  per AS (SELECT entity, week, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0.0) AS v, avg(CASE WHEN refund THEN 1.0 ELSE 0.0 END) AS r, quantile_cont(amount, 0.95) AS p95 FROM w GROUP BY 1, 2),
  g AS (SELECT entity, CAST(unnest(range(w0, (SELECT max(week) FROM per) + 1)) AS INT) AS week FROM (SELECT entity, min(week) AS w0 FROM per GROUP BY 1)),
  d AS (SELECT g.entity, g.week, coalesce(n, 0) AS n, ln(1 + coalesce(n, 0) / 7.0) AS log_velocity, last_value(m IGNORE NULLS) OVER (PARTITION BY g.entity ORDER BY g.week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_amount_mean, coalesce(v, 0.0) AS log_amount_var, coalesce(r, 0.0) AS refund_ratio, coalesce(p95, 0.0) AS p95, CASE WHEN n IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sparse FROM g LEFT JOIN per ON g.entity = per.entity AND g.week = per.week)"""


@query(_WEEK + " SELECT entity, week, n, round(log_velocity, 6) + 0.0 AS log_velocity, round(log_amount_mean, 6) + 0.0 AS log_amount_mean, round(log_amount_var, 6) + 0.0 AS log_amount_var, round(refund_ratio, 6) + 0.0 AS refund_ratio, round(p95, 6) + 0.0 AS p95, round(sparse, 6) + 0.0 AS sparse FROM d")
def agg_window_panel(spark, sf):
    return rounded(weekly.window_panel(events(spark, sf)), "log_velocity", "log_amount_mean", "log_amount_var", "refund_ratio", "p95", "sparse")


@query(_WEEK + """, s AS (SELECT d.*, entity % 3 AS seg, row_number() OVER (PARTITION BY entity ORDER BY week) AS k FROM d), e AS (SELECT * FROM s WHERE k <= 3),
  own AS (SELECT entity, seg, avg(log_amount_mean) AS mean, stddev_pop(log_amount_mean) AS sd, count(*) AS k FROM e GROUP BY 1, 2), peers AS (SELECT seg, stddev_pop(log_amount_mean) AS sd_seg FROM e GROUP BY 1)
  SELECT s.entity, s.week, round(least(10.0, greatest(-10.0, (log_amount_mean - mean) / greatest(own.k / (own.k + 4.0) * sd + (1 - own.k / (own.k + 4.0)) * sd_seg, 1e-9))), 6) + 0.0 AS z FROM s JOIN own ON s.entity = own.entity JOIN peers ON own.seg = peers.seg""")
def g2_standardise(spark, sf):
    got = weekly.window_panel(events(spark, sf)).withColumn("seg", F.col("entity") % 3)
    return rounded(weekly.standardise(got, "log_amount_mean", "seg", burn_in=3), "z")


@query(f"WITH {GRID}, w AS (SELECT entity, day, day - anchor AS age, n, avg(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m, stddev_samp(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sd FROM grid), z AS (SELECT entity, day, (n - m) / greatest(sd, 1e-9) AS z FROM w WHERE age >= 7) SELECT entity, day, round(z, 6) + 0.0 AS z, round(z - median(z) OVER (PARTITION BY day), 6) + 0.0 AS residual FROM z")
def gat_trailing_z(spark, sf):
    """Today against the seven days before, and that less the day's plain median."""
    before = Window.partitionBy("entity").orderBy("day").rangeBetween(-7, -1)
    z = (F.col("n") - F.avg("n").over(before)) / F.greatest(F.stddev_samp("n").over(before), F.lit(1e-9))
    out = grid(spark, sf).withColumn("z", z).filter("day - anchor >= 7").select("entity", "day", "z")
    middle = out.groupBy("day").agg(F.percentile("z", 0.5).alias("m"))
    return rounded(out.join(middle, "day").select("entity", "day", "z", (F.col("z") - F.col("m")).alias("residual")), "z", "residual")


@query(f"WITH {EV}, b AS (SELECT max(day) + 1 AS n FROM ev) SELECT entity, CAST(floor(day / 7.0) AS INT) AS w, count(*) AS k FROM ev, b WHERE (floor(day / 7.0) + 1) * 7 <= b.n GROUP BY 1, 2")
def gat_complete_windows(spark, sf):
    """Counts per whole week; the trailing partial one is left out and empty cells aren't rows."""
    ev = events(spark, sf)
    n = (ev.agg(F.max("day")).first()[0] or 0) + 1
    w = F.floor(F.col("day") / 7).cast("int")
    return ev.withColumn("w", w).filter((F.col("w") + 1) * 7 <= n).groupBy("entity", "w").agg(F.count(F.lit(1)).alias("k"))


@query(f"WITH {EV} SELECT entity, CAST(sum(CASE WHEN NOT refund THEN 1 ELSE 0 END) AS BIGINT) AS n, round(min(CASE WHEN NOT refund THEN epoch_us(t) END) / 1e6, 3) AS first_s FROM ev GROUP BY 1")
def scr_arrival_lists(spark, sf):
    """Arrival lists per entity in time order, refunds left out; their length and head are shown."""
    per = events(spark, sf).groupBy("entity").agg(F.sort_array(F.collect_list(F.when(~F.col("refund"), F.unix_micros("time")))).alias("at"))
    return per.select("entity", F.size("at").cast("bigint").alias("n"), F.round(F.get("at", F.lit(0)) / 1e6, 3).alias("first_s"))


def queries():
    return OUT


def oracle_sql():
    return SQL
