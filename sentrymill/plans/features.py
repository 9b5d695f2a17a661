"""Feature register over the event stream, each feature a query of (entity, day, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily, histograms
from ..roles import bound, events_roles

WARMUP = 7

EV = """ev AS (SELECT event_id, user_id AS entity, regexp_extract(props, '"k": *([0-9]+)', 1) AS counterparty, ts AS t, value AS amount,
  event_type = 'error' AS failed, event_type = 'signup' AS refund, event_type AS category, event_type = 'view' AS foreign_, event_type = 'click' AS absent_,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day FROM events)"""
ROLL = EV + """, roll AS (SELECT entity, day, count(*) AS n, sum(CASE WHEN NOT failed AND NOT refund THEN amount ELSE 0.0 END) AS gmv,
  count(*) FILTER (failed) AS failures, count(*) FILTER (refund) AS refunds, sum(CASE WHEN refund THEN amount ELSE 0.0 END) AS refunded,
  count(*) FILTER (abs(amount-100)<0.005 OR abs(amount-500)<0.005 OR abs(amount-1000)<0.005 OR abs(amount-5000)<0.005) AS round_hits,
  count(*) FILTER (amount <= 10) AS micro, count(*) FILTER (foreign_) AS foreign_n, count(*) FILTER (absent_) AS absent_n,
  max(CASE WHEN NOT failed AND NOT refund THEN amount END) AS largest FROM ev GROUP BY 1, 2)"""
GRID = ROLL + """, anchors AS (SELECT entity, min(day) AS anchor FROM roll GROUP BY 1),
days AS (SELECT entity, anchor, CAST(unnest(range(anchor, (SELECT max(day) FROM roll) + 1)) AS INT) AS day FROM anchors),
grid AS (SELECT d.entity, d.day, d.anchor, coalesce(n, 0) AS n, coalesce(gmv, 0.0) AS gmv, coalesce(failures, 0) AS failures, coalesce(refunds, 0) AS refunds,
  coalesce(refunded, 0.0) AS refunded, coalesce(round_hits, 0) AS round_hits, coalesce(micro, 0) AS micro, coalesce(foreign_n, 0) AS foreign_n, coalesce(absent_n, 0) AS absent_n, largest,
  d.day - d.anchor < 7 AS early, d.day - d.anchor >= 7 AS warm, d.day % 7 >= 5 AS weekend FROM days d LEFT JOIN roll r ON d.entity = r.entity AND d.day = r.day)"""


def frame(days, back=0):
    return f"OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN {days - 1 + back} PRECEDING AND {back} PRECEDING)"


def _z(x):
    """SQL of the self-baselined z of x."""
    s, ss = (f"(sum(CASE WHEN early THEN {v} ELSE 0.0 END) OVER (PARTITION BY entity))" for v in (x, f"({x})*({x})"))
    return f"CASE WHEN warm THEN least(50.0, greatest(-50.0, ({x} - {s}/7) / greatest(sqrt(greatest({ss}/7 - ({s}/7)*({s}/7), 0.0)), 1e-9))) ELSE 0.0 END"


def _share(a, b):
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"


EARLIER = "OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MEAN_GMV = "(sum(CASE WHEN early THEN gmv ELSE 0.0 END) OVER (PARTITION BY entity))/7"
_P0 = "(CASE WHEN (sum(CASE WHEN early THEN gmv ELSE 0.0 END) OVER (PARTITION BY entity)) > 0 THEN (sum(CASE WHEN early AND weekend THEN gmv ELSE 0.0 END) OVER (PARTITION BY entity)) / (sum(CASE WHEN early THEN gmv ELSE 0.0 END) OVER (PARTITION BY entity)) ELSE 0.0 END)"
SQL = {
    "v_txn_count_z": _z("CAST(n AS DOUBLE)"),
    "v_gmv_z": _z("gmv"),
    "v_gmv_accel": f"CASE WHEN warm THEN ((sum(gmv) {frame(7)}) - 2*coalesce(sum(gmv) {frame(7, 7)}, 0.0) + coalesce(sum(gmv) {frame(7, 14)}, 0.0)) / greatest(7*{_MEAN_GMV}, 1.0) ELSE 0.0 END",
    "v_fano_trailing": f"CASE WHEN (sum(n) {frame(28)}) > 0 THEN greatest((sum(CAST(n AS DOUBLE)*n) {frame(28)})/28.0 - ((sum(n) {frame(28)})/28.0)*((sum(n) {frame(28)})/28.0), 0.0) / ((sum(n) {frame(28)})/28.0) ELSE 0.0 END",
    "v_dormant_burst": f"coalesce(day - max(CASE WHEN n > 0 THEN day END) {EARLIER}, 0) * ({_z('CAST(n AS DOUBLE)')})",
    "t_round_amount_share": _share("round_hits", "n"),
    "t_micro_share": _share("micro", "n"),
    "t_new_max_event": f"CASE WHEN (max(largest) {EARLIER}) > 0 AND largest > 3 * (max(largest) {EARLIER}) THEN 1.0 ELSE 0.0 END",
    "i_intl_share": _share("foreign_n", "n"),
    "i_cnp_share": _share("absent_n", "n"),
    "f_auth_fail_rate_z": _z("(CASE WHEN n > 0 THEN CAST(failures AS DOUBLE)/n ELSE 0.0 END)"),
    "d_refund_rate_z": _z("(CASE WHEN n > 0 THEN CAST(refunds AS DOUBLE)/n ELSE 0.0 END)"),
    "d_refund_amount_ratio": _share(f"(sum(refunded) {frame(7)})", f"(sum(gmv) {frame(7)})"),
    "h_weekend_share_z": f"CASE WHEN warm THEN least(50.0, greatest(-50.0, ({_share(f'(sum(CASE WHEN weekend THEN gmv ELSE 0.0 END) {frame(7)})', f'(sum(gmv) {frame(7)})')} - {_P0}) / greatest(sqrt({_P0}*(1-{_P0})/7), 1e-9))) ELSE 0.0 END",
}


def events(spark, sf):
    return bound(spark.read.parquet(f"{sf}/events.parquet"), events_roles())


def panel(spark, sf):
    return daily.add_features(daily.grid(daily.day_roll(events(spark, sf)), daily.last_day(events(spark, sf))), WARMUP)


def rounded(df, *names, digits=6):
    """Doubles rounded, with minus zero as zero, so that engines that sum in other orders agree."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


def _feature(name):
    def query(spark, sf):
        return rounded(panel(spark, sf), name).select("entity", "day", name)

    return query


def v_declared_ratio(spark, sf):
    """30-day volume over what the profile declares; entities without a profile are left out."""
    profile = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("entity"), (F.abs("c_acctbal") + 1000.0).alias("declared"))
    out = panel(spark, sf).join(profile, "entity").select("entity", "day", (F.col("gmv_30") / F.col("declared")).alias("v_declared_ratio"))
    return rounded(out, "v_declared_ratio")


def h_interarrival_cv(spark, sf):
    ev = events(spark, sf)
    return rounded(daily.interarrival_cv(ev, daily.grid(daily.day_roll(ev), daily.last_day(ev))), "h_interarrival_cv")


def f_retry_burst_rate(spark, sf):
    return rounded(daily.retry_bursts(events(spark, sf)), "f_retry_burst_rate")


def agg_day_roll(spark, sf):
    return rounded(daily.day_roll(events(spark, sf)), "gmv", "refunded", "largest").withColumn("n", F.col("n").cast("bigint"))


def t_p95_median_ratio(spark, sf):
    return rounded(histograms.quantile_ratio(events(spark, sf), 0.95, 0.5), "t_p95_median_ratio")


def _divergence(kind, name):
    def query(spark, sf):
        return rounded(histograms.trailing_divergence(events(spark, sf), kind, WARMUP).withColumnRenamed("value", name), name)

    return query


def f_decline_entropy(spark, sf):
    """Buckets by crc32, which DuckDB lacks: no second engine."""
    return rounded(histograms.decline_entropy(events(spark, sf)), "f_decline_entropy")


_SINCE = "1996-01-01"


def p_profile(spark, sf):
    """Static features of a day: age since onboarding (the first order), never bucketed, and profile columns; stand-ins by key."""
    first = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("entity")).agg(F.min("o_orderdate").alias("onboarded"))
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "entity").join(first, "entity", "left")
    return c.select("entity", daily.days_since(F.col("onboarded"), F.lit(_SINCE)).alias("p_days_since_onboarding"), (F.col("entity") % 3).alias("p_kyc_tier"), (F.col("entity") % 120).alias("p_vintage_months"), F.col("c_nationkey").alias("p_city_tier"), F.round("c_acctbal", 6).alias("p_declared_monthly_gmv"))


PROFILE_SQL = f"""WITH f AS (SELECT o_custkey, min(o_orderdate) AS o FROM orders GROUP BY 1)
  SELECT c_custkey AS entity, coalesce(date_diff('day', CAST(o AS DATE), DATE '{_SINCE}'), 0) AS p_days_since_onboarding, c_custkey % 3 AS p_kyc_tier, c_custkey % 120 AS p_vintage_months, c_nationkey AS p_city_tier, round(c_acctbal, 6) AS p_declared_monthly_gmv
  FROM customer LEFT JOIN f ON c_custkey = o_custkey"""


def p_static(spark, sf):
    """Profile passthrough features, and the group code by crc32."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").alias("entity"), (F.crc32(F.col("c_mktsegment").cast("binary")) % 4096).alias("p_mcc_group"), F.col("c_nationkey").alias("p_city_tier"), F.round("c_acctbal", 6).alias("p_declared_monthly_gmv"))


_HIST = """, cells AS (SELECT entity, day, {bucket} AS b, count(*) AS k FROM ev WHERE {keep} GROUP BY 1, 2, 3),
span AS (SELECT entity, anchor, day FROM grid), buckets AS (SELECT unnest(range({nb})) AS b),
dense AS (SELECT s.entity, s.day, s.anchor, u.b, coalesce(c.k, 0) AS k FROM span s, buckets u LEFT JOIN cells c ON c.entity = s.entity AND c.day = s.day AND c.b = u.b),
sums AS (SELECT entity, day, anchor, b, sum(k) OVER (PARTITION BY entity, b ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS w,
  sum(CASE WHEN day - anchor < 7 THEN k ELSE 0 END) OVER (PARTITION BY entity, b) AS base FROM dense),
mass AS (SELECT *, sum(w) OVER (PARTITION BY entity, day) AS wt, sum(base) OVER (PARTITION BY entity, day) AS bt FROM sums),
pq AS (SELECT *, CASE WHEN wt > 0 THEN CAST(w AS DOUBLE)/wt ELSE 0.0 END AS p, CASE WHEN bt > 0 THEN CAST(base AS DOUBLE)/bt ELSE 0.0 END AS q FROM mass)"""
_JSD = "sum(CASE WHEN p > 0 THEN 0.5*p*log2(2*p/(p+q)) ELSE 0.0 END + CASE WHEN q > 0 THEN 0.5*q*log2(2*q/(p+q)) ELSE 0.0 END)"
_LOGBIN = "CAST(least(31, greatest(0, floor(log10(greatest(amount, 1.0)) / 7 * 32))) AS INT)"


def _hist_sql(name, bucket, keep, nb, value):
    if name == "t_wasserstein_7d":
        body = ", cdf AS (SELECT *, abs(sum(p - q) OVER (PARTITION BY entity, day ORDER BY b)) AS gap FROM pq) SELECT entity, day, round(CASE WHEN max(wt) > 0 AND max(bt) > 0 AND day - max(anchor) >= 7 THEN sum(gap) * 7.0/32 ELSE 0.0 END, 6) + 0.0 AS {n} FROM cdf GROUP BY entity, day"
    else:
        body = " SELECT entity, day, round(CASE WHEN max(wt) > 0 AND max(bt) > 0 AND day - max(anchor) >= 7 THEN greatest(0.0, {v}) ELSE 0.0 END, 6) + 0.0 AS {n} FROM pq GROUP BY entity, day"
    return "WITH " + GRID + _HIST.format(bucket=bucket, keep=keep, nb=nb) + body.format(n=name, v=value)


def queries():
    out = {name: _feature(name) for name in SQL}
    out |= {f.__name__: f for f in (v_declared_ratio, h_interarrival_cv, f_retry_burst_rate, agg_day_roll, t_p95_median_ratio, f_decline_entropy, p_static, p_profile)}
    out |= {name: _divergence(kind, name) for kind, name in (("amount", "t_wasserstein_7d"), ("category", "i_mix_jsd"), ("hour", "h_hourly_jsd"))}
    return out


def oracle_sql():
    out = {name: f"WITH {GRID} SELECT entity, day, round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name} FROM grid" for name, x in SQL.items()}
    out["v_declared_ratio"] = f"WITH {GRID}, p AS (SELECT entity, day, sum(gmv) {frame(30)} AS g FROM grid) SELECT entity, day, round(g / (abs(c_acctbal) + 1000.0), 6) + 0.0 AS v_declared_ratio FROM p JOIN customer ON c_custkey = entity"
    out["h_interarrival_cv"] = f"""WITH {GRID}, g AS (SELECT entity, day, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY entity ORDER BY t, event_id)) / 1e6 AS gap FROM ev),
      per AS (SELECT entity, day, count(gap) AS k, sum(gap) AS s, sum(gap*gap) AS ss FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
      j AS (SELECT grid.entity, grid.day, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss FROM grid LEFT JOIN per ON grid.entity = per.entity AND grid.day = per.day),
      w AS (SELECT entity, day, sum(k) {frame(7)} AS k, sum(s) {frame(7)} AS s, sum(ss) {frame(7)} AS ss FROM j)
      SELECT entity, day, round(CASE WHEN k >= 2 AND s > 0 THEN sqrt(greatest(ss/k - (s/k)*(s/k), 0.0)) / (s/k) ELSE 0.0 END, 6) + 0.0 AS h_interarrival_cv FROM w"""
    lags = " + ".join(f"CASE WHEN lag(counterparty, {k}) OVER o = counterparty AND epoch_us(t) - epoch_us(lag(t, {k}) OVER o) <= 600000000 THEN 1 ELSE 0 END" for k in range(1, 9))
    out["f_retry_burst_rate"] = f"WITH {EV}, b AS (SELECT entity, day, {lags} >= 2 AS burst FROM ev WINDOW o AS (PARTITION BY entity ORDER BY t, event_id)) SELECT entity, day, round(avg(CASE WHEN burst THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS f_retry_burst_rate FROM b GROUP BY 1, 2"
    out["agg_day_roll"] = f"WITH {ROLL} SELECT entity, day, n, round(gmv, 6) + 0.0 AS gmv, failures, refunds, round(refunded, 6) + 0.0 AS refunded, round_hits, micro, foreign_n, absent_n, round(largest, 6) + 0.0 AS largest FROM roll"
    out["t_p95_median_ratio"] = f"""WITH {EV}, h AS (SELECT entity, {_LOGBIN} AS b, count(*) AS k FROM ev WHERE NOT failed AND NOT refund GROUP BY 1, 2),
      c AS (SELECT entity, b, sum(k) OVER (PARTITION BY entity ORDER BY b) AS cum, sum(k) OVER (PARTITION BY entity) AS total FROM h),
      q AS (SELECT entity, min(CASE WHEN cum >= 0.95*total THEN b END) AS hi, min(CASE WHEN cum >= 0.5*total THEN b END) AS lo FROM c GROUP BY 1)
      SELECT entity, round(pow(10, (hi - lo) * 7.0/32), 6) + 0.0 AS t_p95_median_ratio FROM q"""
    out["t_wasserstein_7d"] = _hist_sql("t_wasserstein_7d", _LOGBIN, "NOT failed AND NOT refund", 32, "")
    out["i_mix_jsd"] = _hist_sql("i_mix_jsd", "CASE category WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END", "true", 5, _JSD)
    out["p_profile"] = PROFILE_SQL
    out["h_hourly_jsd"] = _hist_sql("h_hourly_jsd", "CAST(hour(t) AS INT)", "true", 24, _JSD)
    return out
