"""Scans, projections, joins, aggregates and set operations over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, crc_bucket, exposure, fold_of, round_hit, severity, shrunk
from ..operators import daily, payers
from ..operators.histograms import log_bin
from ..sources import readers, sinks
from .features import EV, ROLL, events, rounded

UTC = dt.timezone.utc
AS_OF = dt.datetime(2024, 1, 20, 12, tzinfo=UTC)
SHIP_AS_OF = dt.datetime(1998, 6, 1, tzinfo=UTC)
OUT: dict = {}
SQL: dict = {}


def query(sql=None):
    def add(f):
        OUT[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labels(spark, sf):
    """Documents as entities: a label is available some days after its document; a third is censored."""
    out = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    at = F.timestamp_add("DAY", (F.col("doc_id") % 60).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("doc_id", F.col("toxic").alias("label"), at.alias("label_available_at"), (F.col("doc_id") % 3 == 0).alias("is_censored"))


_LABELS = "lab AS (SELECT l.doc_id, toxic AS label, TIMESTAMP '2024-01-01' + to_days(CAST(l.doc_id % 60 AS INT)) AS label_available_at, l.doc_id % 3 = 0 AS is_censored FROM labels l JOIN documents d USING (doc_id))"


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND user_id = 7")
def src_events_asof(spark, sf):
    got = readers.events_as_of(t(spark, sf, "events"), "ts", AS_OF, "user_id", 7, dt.datetime(2024, 1, 5, tzinfo=UTC))
    return got.select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, strftime(CASE WHEN l_shipdate <= TIMESTAMP '1998-06-01' THEN l_shipdate END, '%Y-%m-%d') AS settled FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-06-01'")
def src_payouts_asof(spark, sf):
    both = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return readers.masked_as_of(both, "o_orderdate", "l_shipdate", SHIP_AS_OF).select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("settled"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def src_profiles(spark, sf):
    return t(spark, sf, "supplier").filter(F.col("s_suppkey").isin(1, 3, 5)).select("s_suppkey", "s_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def src_active(spark, sf):
    return readers.events_as_of(t(spark, sf, "orders"), "o_orderdate", dt.datetime(1996, 1, 1, tzinfo=UTC)).select("o_custkey").distinct()


@query("SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events")
def src_bounds(spark, sf):
    return readers.bounds(t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d")), "d")


@query(f"WITH {_LABELS} SELECT doc_id, label FROM lab WHERE label_available_at <= TIMESTAMP '2024-01-20 12:00:00' AND NOT is_censored")
def src_labels_asof(spark, sf):
    return readers.available_labels(labels(spark, sf), AS_OF).select("doc_id", "label")


@query(f"""WITH {_LABELS}, c AS (SELECT count(*) AS total, count(*) FILTER (label_available_at <= TIMESTAMP '2024-01-20 12:00:00' AND NOT is_censored) AS available, count(*) FILTER (is_censored) AS censored,
  count(*) FILTER (label_available_at <= TIMESTAMP '2024-01-20 12:00:00' AND NOT is_censored AND label = 1) AS positive FROM lab)
  SELECT total, available, censored, positive, total - censored - available AS pending, round(positive / available, 6) AS prevalence, round(available / total, 6) AS coverage FROM c""")
def src_label_coverage(spark, sf):
    return rounded(readers.label_coverage(labels(spark, sf), AS_OF), "prevalence", "coverage")


@query("SELECT CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def src_json_rows(spark, sf):
    return t(spark, sf, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query()
def snk_content_hash(spark, sf):
    return sinks.content_hash(t(spark, sf, "orders"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN NOT failed AND NOT refund THEN amount ELSE 0.0 END, 6) AS gmv FROM ev")
def prj_captured(spark, sf):
    return rounded(events(spark, sf).select("event_id", F.when(daily.captured(F.col("failed"), F.col("refund")), F.col("amount")).otherwise(0.0).alias("gmv")), "gmv")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0.0 END, 6) AS r FROM lineitem")
def prj_guarded_ratio(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(daily.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("r"))


@query("SELECT p_partkey, abs(p_retailprice-100)<0.005 OR abs(p_retailprice-500)<0.005 OR abs(p_retailprice-1000)<0.005 OR abs(p_retailprice-5000)<0.005 AS hit, p_retailprice <= 950 AS micro FROM part")
def prj_round_hit(spark, sf):
    return t(spark, sf, "part").select("p_partkey", round_hit(F.col("p_retailprice")).alias("hit"), (F.col("p_retailprice") <= 950).alias("micro"))


@query("SELECT o_orderkey, CAST(least(31, greatest(0, floor(log10(greatest(o_totalprice, 1.0)) / 7 * 32))) AS INT) AS bin FROM orders")
def prj_log_bin(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", log_bin(F.col("o_totalprice")).alias("bin"))


@query()
def prj_crc_bucket(spark, sf):
    return t(spark, sf, "part").select("p_partkey", crc_bucket(F.col("p_brand"), 4096).alias("code"))


@query("SELECT event_id, round(least(1.0, greatest(0.0, (value - 100) / 200)), 6) AS sev, round(least(300.0, greatest(50.0, value)), 6) AS clipped FROM events")
def prj_severity(spark, sf):
    return t(spark, sf, "events").select("event_id", F.round(severity(F.col("value"), 100, 200), 6).alias("sev"), F.round(clip(F.col("value"), 50.0, 300.0), 6).alias("clipped"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS code FROM events")
def prj_map_lookup(spark, sf):
    codes = F.create_map(*[F.lit(x) for kv in {"view": 1, "click": 2, "purchase": 3}.items() for x in kv])
    return t(spark, sf, "events").select("event_id", F.try_element_at(codes, F.col("event_type")).alias("code"))


@query("SELECT event_id, CAST(event_type = 'error' AS INT) AS is_error, CAST(event_type = 'purchase' AS INT) AS is_purchase, CAST(event_type = 'signup' AS INT) AS is_signup, CAST(event_type = 'view' AS INT) AS is_view FROM events")
def prj_one_hot(spark, sf):
    """First category dropped; categories are a fixed list, absent ones are zero columns."""
    kinds = ("error", "purchase", "signup", "view")
    return t(spark, sf, "events").select("event_id", *[(F.col("event_type") == k).cast("int").alias(f"is_{k}") for k in kinds])


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, CAST(floor(date_diff('day', (SELECT CAST(min(o_orderdate) AS DATE) FROM orders), CAST(o_orderdate AS DATE)) / 7.0) AS INT) AS week FROM orders")
def prj_window_index(spark, sf):
    orders = t(spark, sf, "orders")
    first = orders.agg(F.min(F.to_date("o_orderdate"))).first()[0]
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", F.datediff(day, F.lit("1995-01-01").cast("date")).alias("day"), F.floor(F.datediff(day, F.lit(first)) / 7).cast("int").alias("week"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1000.0 * (c_acctbal / 5000) ELSE 1000.0 END, 6) AS e FROM customer")
def prj_exposure(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.round(exposure(F.lit(1000.0), F.col("c_acctbal") / 5000), 6).alias("e"))


@query("SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier WHERE s_acctbal <= 0 OR s_nationkey NOT BETWEEN 1 AND 24")
def prj_row_validate(spark, sf):
    """Rows that break an invariant: balance over zero, tier within bounds."""
    return t(spark, sf, "supplier").filter((F.col("s_acctbal") <= 0) | ~F.col("s_nationkey").between(1, 24)).select("s_suppkey", "s_name", F.round("s_acctbal", 6).alias("s_acctbal"))


@query("SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(v, 0.0), 4) + 0.0 AS v FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def agg_volume(spark, sf):
    """Volume up to a cutoff, entities without any at zero."""
    got = readers.events_as_of(t(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderdate", SHIP_AS_OF).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    return rounded(t(spark, sf, "customer").select("c_custkey").join(got, "c_custkey", "left").fillna(0), "v", digits=4)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, sf):
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(spark, sf):
    urgent = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


_INTERVALS = "iv AS (SELECT user_id AS entity, CAST(5 + user_id % 7 AS INT) AS start_day, CAST(12 + user_id % 11 AS INT) AS end_day FROM (SELECT DISTINCT user_id FROM events))"


def intervals(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct().select("entity", (5 + F.col("entity") % 7).cast("int").alias("start_day"), (12 + F.col("entity") % 11).cast("int").alias("end_day"))


@query(f"WITH {EV}, {_INTERVALS} SELECT e.entity, count(DISTINCT event_id) AS n, round(sum(amount), 4) AS loss FROM ev e JOIN iv ON e.entity = iv.entity AND e.day >= start_day AND e.day < end_day GROUP BY 1")
def join_interval(spark, sf):
    """Events within their entity's interval, start inclusive and end exclusive: an equi-join with a residual."""
    return rounded(payers.in_intervals(events(spark, sf), intervals(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("loss")), "loss", digits=4)


@query(f"WITH {EV}, a AS (SELECT event_id, entity, t FROM ev WHERE category = 'purchase'), b AS (SELECT event_id AS prior_id, entity, t FROM ev WHERE category = 'view') SELECT a.event_id, b.prior_id FROM a ASOF LEFT JOIN b ON a.entity = b.entity AND a.t >= b.t")
def join_asof(spark, sf):
    """For each purchase the last view at or before it, by one sorted window over the union, not a range join."""
    ev = events(spark, sf)
    return payers.as_of(ev.filter("category = 'purchase'"), ev.filter("category = 'view'")).select("event_id", "prior_id")


@query(f"WITH {ROLL}, g AS (SELECT entity, CAST(day AS INT) AS day FROM (SELECT DISTINCT entity FROM ev), (SELECT unnest(range((SELECT min(day) FROM ev), (SELECT max(day) FROM ev) + 1)) AS day)) SELECT g.entity, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN roll r ON g.entity = r.entity AND g.day = r.day")
def agg_daily_matrix(spark, sf):
    """Dense entity by day counts: each entity's days come from a sequence, so no cross join."""
    rolled = daily.day_roll(events(spark, sf)).select("entity", "day", "n")
    first, last = rolled.agg(F.min("day"), F.max("day")).first()
    days = rolled.select("entity").distinct().withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return days.join(rolled, ["entity", "day"], "left").fillna(0)


_CATEGORIES = ("click", "error", "purchase", "view")
_SHARES = ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN 1.0 ELSE 0.0 END), 6) AS {c}_share" for c in _CATEGORIES)


@query(f"""WITH {EV}, kept AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_id % 11 END AS device FROM ev WHERE NOT refund), first_day AS (SELECT entity, counterparty, min(day) AS d0 FROM kept GROUP BY 1, 2),
  dp AS (SELECT entity, device, count(DISTINCT counterparty) AS payers FROM kept WHERE device IS NOT NULL GROUP BY 1, 2)
  SELECT k.entity, k.day, k.counterparty, epoch_us(max(t)) AS last_event_us, count(*) AS txn_count, round(sum(amount), 6) AS value_sum, round(CASE WHEN sum(amount) > 0 THEN coalesce(stddev_pop(amount), 0) * count(*) / sum(amount) ELSE 0.0 END, 6) + 0.0 AS ticket_cv,
  round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, {_SHARES}, max(CASE WHEN k.day = d0 THEN 1 ELSE 0 END) AS payer_is_new, coalesce(max(payers), 1) AS device_shared_payers
  FROM kept k JOIN first_day f ON k.entity = f.entity AND k.counterparty = f.counterparty LEFT JOIN dp ON k.entity = dp.entity AND k.device = dp.device GROUP BY 1, 2, 3""")
def agg_capsule(spark, sf):
    got = payers.capsules(events(spark, sf), _CATEGORIES).withColumn("last_event_us", F.unix_micros("last_event_time")).drop("last_event_time")
    return rounded(got, "value_sum", "ticket_cv", "failure_rate", *[f"{c}_share" for c in _CATEGORIES])


@query("""WITH d AS (SELECT user_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS device, count(DISTINCT event_type) AS k FROM events GROUP BY 1, 2)
  SELECT user_id AS entity, max(k) AS shared FROM d GROUP BY 1""")
def agg_distinct_exact(spark, sf):
    per = t(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.get_json_object("props", "$.k").alias("device")).agg(F.countDistinct("event_type").alias("k"))
    return per.groupBy("entity").agg(F.max("k").alias("shared"))


@query(f"WITH {EV}, c AS (SELECT entity, CAST(floor(day / 7.0) AS INT) AS week, category, count(*) AS k FROM ev GROUP BY 1, 2, 3), p AS (SELECT *, k / sum(k) OVER (PARTITION BY entity, week) AS p FROM c) SELECT entity, week, round(sum(-p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY 1, 2")
def agg_entropy_nats(spark, sf):
    return rounded(payers.entropy(payers.weekly(events(spark, sf)), ["entity", "week"], "category").withColumnRenamed("h", "entropy"), "entropy")


_PAYER = f"""WITH {EV}, w AS (SELECT entity, CAST(floor(day / 7.0) AS INT) AS week, counterparty, count(*) AS k, sum(amount) AS a FROM ev WHERE counterparty IS NOT NULL GROUP BY 1, 2, 3),
  x AS (SELECT *, lag(week) OVER (PARTITION BY entity, counterparty ORDER BY week) AS before, min(week) OVER (PARTITION BY entity, counterparty) AS first_week, sum(k) OVER (PARTITION BY entity, week) AS kt, sum(a) OVER (PARTITION BY entity, week) AS at_ FROM w),
  s AS (SELECT entity, week, count(*) AS payers, count(*) FILTER (before = week - 1) AS shared, sum(-(k/kt) * ln(k/kt)) AS h, sum((a/at_)*(a/at_)) AS hhi, sum(CASE WHEN first_week = week THEN k ELSE 0 END) / max(kt) AS fresh, count(*) FILTER (first_week < week) / count(*) AS again FROM x GROUP BY 1, 2),
  j AS (SELECT s.*, coalesce(p.payers, 0) AS was FROM s LEFT JOIN s p ON p.entity = s.entity AND p.week = s.week - 1)"""


@query(_PAYER + " SELECT entity, week, payers, round(h, 6) + 0.0 AS payer_entropy, round(hhi, 6) + 0.0 AS payer_herfindahl, round(fresh, 6) + 0.0 AS new_payer_ratio, round(again, 6) + 0.0 AS repeat_payer_ratio, round(CASE WHEN payers + was - shared > 0 THEN shared / (payers + was - shared) ELSE 0.0 END, 6) + 0.0 AS payer_jaccard_prev FROM j")
def agg_payer_graph(spark, sf):
    return rounded(payers.payer_graph(events(spark, sf)), "payer_entropy", "payer_herfindahl", "new_payer_ratio", "repeat_payer_ratio", "payer_jaccard_prev")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O, count(*) AS total FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'TOTAL', count(*) FILTER (l_linestatus = 'F'), count(*) FILTER (l_linestatus = 'O'), count(*) FROM lineitem")
def agg_pivot(spark, sf):
    """Pivot on a fixed list with a TOTAL row, by rollup: the table is read once."""
    per = t(spark, sf, "lineitem").rollup("l_returnflag").agg(*[F.count_if(F.col("l_linestatus") == s).alias(s) for s in ("F", "O")], F.count(F.lit(1)).alias("total"))
    return per.withColumn("l_returnflag", F.coalesce("l_returnflag", F.lit("TOTAL")))


@query(f"WITH {EV}, {_INTERVALS} SELECT e.entity, round(sum(CASE WHEN e.day >= start_day AND e.day < end_day THEN amount ELSE 0.0 END), 4) + 0.0 AS loss, round(sum(CASE WHEN NOT refund THEN amount ELSE 0.0 END), 4) + 0.0 AS worth FROM ev e JOIN iv ON e.entity = iv.entity GROUP BY 1")
def agg_loss_value(spark, sf):
    joined = events(spark, sf).join(intervals(spark, sf), "entity")
    inside = (F.col("day") >= F.col("start_day")) & (F.col("day") < F.col("end_day"))
    return rounded(joined.groupBy("entity").agg(F.sum(F.when(inside, F.col("amount")).otherwise(0.0)).alias("loss"), F.sum(F.when(~F.col("refund"), F.col("amount")).otherwise(0.0)).alias("worth")), "loss", "worth", digits=4)


@query(f"""WITH {EV}, p AS (SELECT entity, count(*) AS n, stddev_pop(ln(greatest(amount, 0.01))) AS log_sd, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.9) AS p90, avg(hour(t)) AS hour_mean, avg(CASE WHEN refund THEN 1.0 ELSE 0.0 END) AS refund_rate FROM ev GROUP BY 1 HAVING count(*) >= 2)
  SELECT round(median(log_sd), 6) AS log_sd, round(median(p50), 6) AS p50, round(median(p90 / p50), 6) AS p90_p50, round(median(hour_mean), 6) AS hour_mean, round(median(refund_rate), 6) AS refund_rate, count(*) AS entities FROM p""")
def agg_profile_pop(spark, sf):
    """Calibration marginals per entity, then their medians across entities with two rows or more."""
    a = F.col("amount")
    per = events(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.ln(F.greatest(a, F.lit(0.01)))).alias("log_sd"), F.percentile(a, 0.5).alias("p50"), F.percentile(a, 0.9).alias("p90"), F.avg(F.hour("time")).alias("hour_mean"), F.avg(F.col("refund").cast("double")).alias("refund_rate")).filter("n >= 2")
    per = per.withColumn("p90_p50", F.col("p90") / F.col("p50"))
    names = ("log_sd", "p50", "p90_p50", "hour_mean", "refund_rate")
    return rounded(per.agg(*[F.percentile(c, 0.5).alias(c) for c in names], F.count(F.lit(1)).alias("entities")), *names)


@query(f"WITH {EV}, c AS (SELECT entity, CAST(floor(day / 7.0) AS INT) AS week, category, count(*) AS n FROM ev GROUP BY 1, 2, 3) SELECT entity, week, category AS mode FROM c QUALIFY row_number() OVER (PARTITION BY entity, week ORDER BY n DESC, category) = 1")
def agg_calendar_mode(spark, sf):
    per = payers.weekly(events(spark, sf)).groupBy("entity", "week", "category").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("entity", "week").agg(F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("mode"))


@query(f"WITH {ROLL}, g AS (SELECT entity, unnest(range(30)) AS day FROM (SELECT DISTINCT entity FROM ev)), d AS (SELECT g.entity, coalesce(n, 0) AS n FROM g LEFT JOIN roll r ON g.entity = r.entity AND g.day = r.day), f AS (SELECT entity, var_samp(n) / avg(n) AS fano, var_pop(n) / avg(n) AS fano_pop FROM d GROUP BY 1) SELECT round(avg(fano), 6) AS fano, round(avg(fano_pop), 6) AS fano_pop FROM f")
def agg_fano(spark, sf):
    """Variance over mean of daily counts by sums alone: empty days need no rows."""
    per = daily.day_roll(events(spark, sf)).filter("day between 0 and 29").groupBy("entity").agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("ss"))
    mean = F.col("s") / 30
    spread = F.col("ss") - 30 * mean * mean
    return rounded(per.agg(F.avg(spread / 29 / mean).alias("fano"), F.avg(spread / 30 / mean).alias("fano_pop")), "fano", "fano_pop")


@query(f"WITH {ROLL}, m AS (SELECT entity, avg(n) AS mean, var_samp(n) / avg(n) AS f, count(*) AS k FROM roll GROUP BY 1) SELECT entity, round(CASE WHEN k < 2 OR mean <= 0 THEN NULL WHEN f <= 1 THEN -1.0 ELSE mean / (f - 1) END, 6) AS r FROM m")
def agg_nb_dispersion(spark, sf):
    """Negative binomial size by moments; -1 stands for infinity, null for undefined.

    Variance and mean are compared by whole numbers: where they are equal, a variance in floating
    point falls on either side of the mean by the order of its rows.
    """
    n = F.col("n").cast("decimal(18,0)")
    per = daily.day_roll(events(spark, sf)).groupBy("entity").agg(F.sum(n).alias("s"), F.sum(n * n).alias("ss"), F.count(F.lit(1)).cast("decimal(10,0)").alias("k"))
    s, k = F.col("s").cast("decimal(18,0)"), F.col("k")
    over = k * F.col("ss").cast("decimal(27,0)") - s * s - (k - 1) * s
    r = (k - 1).cast("double") * s.cast("double") * s.cast("double") / (k.cast("double") * over.cast("double"))
    return per.select("entity", F.round(F.when((k < 2) | (s <= 0), None).when(over <= 0, -1.0).otherwise(r), 6).alias("r"))


@query("WITH q AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS i FROM orders) SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN i = 0 THEN 1 ELSE i END, 6) + 0.0 AS z FROM orders, q")
def agg_robust(spark, sf):
    """Median and quartiles are one row on the driver; the scaling is a projection."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    low, mid, high = orders.agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or (0.0, 0.0, 0.0)
    return rounded(orders.select("o_orderkey", ((F.col("o_totalprice") - mid) / ((high - low) or 1.0)).alias("z")), "z")


@query("SELECT c_nationkey, round((n * m + 30.0 * g) / (n + 30.0), 6) + 0.0 AS shrunk FROM (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), (SELECT avg(c_acctbal) AS g FROM customer)")
def coh_eb_shrink(spark, sf):
    customer = t(spark, sf, "customer")
    g = customer.agg(F.avg("c_acctbal")).first()[0]
    per = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    return rounded(per.select("c_nationkey", shrunk(F.col("m"), F.col("n"), F.lit(g)).alias("shrunk")), "shrunk")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def set_concat(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(t(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, sf, "orders").select("o_custkey"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def set_disjoint(spark, sf):
    """Entities found in more than one class: an empty result is the passing state."""
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k")).filter("k > 1")


@query("SELECT c_custkey, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS fold FROM (SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 15)) AS BIGINT) / 1152921504606846976.0 AS u FROM customer)")
def spl_fold(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", fold_of(F.col("c_custkey"), {"train": 0.6, "val": 0.2, "test": 0.2}).alias("fold"))


@query("SELECT o_orderkey, CASE WHEN d < 1000 THEN 'train' WHEN d < 1600 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)")
def spl_day(spark, sf):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return t(spark, sf, "orders").select("o_orderkey", F.when(d < 1000, "train").when(d < 1600, "val").otherwise("test").alias("split"))


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 AS INT) AS g FROM customer")
def spl_g2_groups(spark, sf):
    """Dealt in turn within each class. The window sorts a class's rows, as the deal is by position."""
    return t(spark, sf, "customer").select("c_custkey", ((F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1) % 5).cast("int").alias("g"))


def queries():
    return OUT


def oracle_sql():
    return SQL
