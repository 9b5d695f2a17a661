"""Second half of the evaluation surface: profiles, gates, splits, wrappers, reports, model rungs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import daily, decide, evaluate, generate, payers, sequences
from ..operators.daily import trailing
from .behaviour import _STATE, grid, states
from .decisions import _ACT, _S, _TTD, _detected, decided, scored, t
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


@query(f"WITH {EV}, p AS (SELECT day < 15 AS early, avg(amount) AS mean, median(amount) AS p50, avg(CASE WHEN refund THEN 1.0 ELSE 0.0 END) AS refund_rate FROM ev GROUP BY 1) SELECT round(a.mean / b.mean, 6) AS mean_ratio, round(a.p50 / b.p50, 6) AS p50_ratio, round(abs(a.refund_rate - b.refund_rate), 6) + 0.0 AS refund_gap FROM p a JOIN p b ON a.early AND NOT b.early")
def agg_profile_diff(spark, sf):
    """Marginals of two periods side by side; two rows meet in one aggregate."""
    per = events(spark, sf).groupBy((F.col("day") < 15).alias("early")).agg(F.avg("amount").alias("mean"), F.percentile("amount", 0.5).alias("p50"), F.avg(F.col("refund").cast("double")).alias("r"))
    at = lambda c, early: F.max(F.when(F.col("early") == early, F.col(c)))
    return rounded(per.agg((at("mean", True) / at("mean", False)).alias("mean_ratio"), (at("p50", True) / at("p50", False)).alias("p50_ratio"), F.abs(at("r", True) - at("r", False)).alias("refund_gap")), "mean_ratio", "p50_ratio", "refund_gap")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders GROUP BY 1")
def gat_month_rate(spark, sf):
    return rounded(t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate")), "rate")


_Z = f"z AS (SELECT entity, day, {FEATURE_SQL['v_txn_count_z']} AS z, day - anchor AS age FROM grid)"


def z_days(spark, sf):
    return panel(spark, sf).select("entity", "day", F.col("v_txn_count_z").alias("z"), (F.col("day") - F.col("anchor")).alias("age")).filter("age >= 7")


@query(f"WITH {GRID}, {_Z}, q AS (SELECT quantile_cont(z, 0.95) AS th FROM z WHERE age >= 7 AND day < 20) SELECT round(max(th), 6) AS threshold, round(avg(CASE WHEN z > th THEN 1.0 ELSE 0.0 END), 6) AS rate FROM z, q WHERE age >= 7")
def gat_calibrate(spark, sf):
    """Threshold at the nominal rate on quiet days, and the alert rate it gives overall."""
    z = z_days(spark, sf)
    th = z.filter("day < 20").agg(F.percentile("z", 0.95)).first()[0] or 0.0
    return rounded(z.agg(F.lit(th).alias("threshold"), F.avg((F.col("z") > th).cast("double")).alias("rate")), "threshold", "rate")


@query(f"WITH {GRID}, {_Z}, w(name, start_, end_) AS (VALUES ('first', 8, 12), ('sale', 12, 16), ('late', 20, 29)) SELECT name, round(avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) - 0.05, 6) AS excess FROM z JOIN w ON day >= start_ AND day < end_ WHERE age >= 7 GROUP BY 1")
def gat_window_excess(spark, sf):
    windows = spark.createDataFrame([("first", 8, 12), ("sale", 12, 16), ("late", 20, 29)], "name string, start int, end int")
    return rounded(evaluate.window_excess(z_days(spark, sf).withColumn("alert", F.col("z") > 2), windows, 0.05), "rate", "excess")


@query(f"WITH {GRID}, {_Z}, {_STATE}, f AS (SELECT entity, min(CASE WHEN z > 1.5 AND age >= 7 THEN day END) AS found FROM z GROUP BY 1), o AS (SELECT entity, min(CASE WHEN state = 'BUSY' THEN day END) AS truth FROM s GROUP BY 1) SELECT round(quantile_cont(found - truth, 0.25), 6) + 0.0 AS q25, round(median(found - truth), 6) + 0.0 AS median, round(quantile_cont(found - truth, 0.75), 6) + 0.0 AS q75, round(quantile_cont(found - truth, 0.75) - quantile_cont(found - truth, 0.25), 6) + 0.0 AS iqr, count(*) FILTER (found IS NULL) AS unlocalised FROM f JOIN o USING (entity)")
def met_onset(spark, sf):
    found = panel(spark, sf).groupBy("entity").agg(F.min(F.when((F.col("v_txn_count_z") > 1.5) & (F.col("day") - F.col("anchor") >= 7), F.col("day"))).alias("found"))
    truth = states(spark, sf).groupBy("entity").agg(F.min(F.when(F.col("state") == "BUSY", F.col("day"))).alias("truth"))
    return rounded(evaluate.onset_error(found.join(truth, "entity"), "found", "truth"), "q25", "median", "q75", "iqr")


@query(f"WITH {_TTD} SELECT round(median(coalesce(ttd, 1e9)), 6) AS median_ttd, round(avg(CASE WHEN ttd IS NULL THEN 0.0 ELSE 1.0 END), 6) AS detected FROM ttd")
def met_median_ttd(spark, sf):
    """Median with the undetected as far off, so that it says so when they are over half."""
    return rounded(_detected(spark, sf).agg(F.percentile(F.coalesce(F.col("ttd"), F.lit(1e9)), 0.5).alias("median_ttd"), F.avg(F.col("ttd").isNotNull().cast("double")).alias("detected")), "median_ttd", "detected")


@query(f"WITH {_S}, {_ACT} SELECT stratum, round(count(*) FILTER (bad AND action <> 'PASS') / count(*) FILTER (bad), 6) AS recall, count(*) FILTER (bad) AS n FROM d GROUP BY 1")
def met_recall_typ(spark, sf):
    hit = F.col("bad") & (F.col("action") != "PASS")
    return rounded(decided(spark, sf).groupBy("stratum").agg((F.count_if(hit) / F.count_if("bad")).alias("recall"), F.count_if("bad").alias("n")), "recall")


@query(f"WITH {_S}, {_ACT} SELECT round(100 * sum(CASE WHEN NOT bad AND action = 'REVIEW' THEN 250.0 WHEN NOT bad AND action = 'HOLD' THEN 8250.0 ELSE 0.0 END) / sum(CASE WHEN bad THEN loss ELSE 0.0 END), 6) AS fp_per_100 FROM d")
def met_asym(spark, sf):
    """What false alerts cost for each 100 of losses."""
    false = F.when(~F.col("bad"), decide.realised_cost(F.col("action"), F.col("bad"), F.col("loss"))).otherwise(0.0)
    return rounded(decided(spark, sf).agg((100 * F.sum(false) / F.sum(F.when(F.col("bad"), F.col("loss")).otherwise(0.0))).alias("fp_per_100")), "fp_per_100")


@query(f"WITH {_S}, {_ACT}, b AS (SELECT CASE WHEN day < 600 THEN 'before' WHEN day < 1200 THEN 'shock' ELSE 'after' END AS bucket, action FROM d WHERE NOT bad) SELECT bucket, count(*) AS n, round(avg(CASE WHEN action <> 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS alerted FROM b GROUP BY 1".replace("b AS (SELECT CASE", "bk AS (SELECT CASE").replace("FROM b GROUP BY 1", "FROM bk GROUP BY 1"))
def met_shock(spark, sf):
    """Alert rates of healthy rows before, within and after a shock."""
    bucket = F.when(F.col("day") < 600, "before").when(F.col("day") < 1200, "shock").otherwise("after")
    return rounded(decided(spark, sf).filter("not bad").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("action") != "PASS").cast("double")).alias("alerted")), "alerted")


_FOUND = "fs AS (SELECT *, CASE WHEN day % 5 = 0 THEN 'NORMAL' ELSE state END AS found FROM s)"


@query(f"WITH {GRID}, {_STATE}, {_FOUND}, c AS (SELECT state, found, count(*) AS n FROM fs GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY state) AS ra, sum(n) OVER (PARTITION BY found) AS rb FROM c) SELECT round(2 * sum(n/t * ln(n*t/ra/rb)) / (sum(-n/t*ln(ra/t)) + sum(-n/t*ln(rb/t))), 6) AS nmi FROM m")
def met_nmi(spark, sf):
    found = states(spark, sf).withColumn("found", F.when(F.col("day") % 5 == 0, "NORMAL").otherwise(F.col("state")))
    return rounded(evaluate.normalised_mutual_information(found, "state", "found"), "nmi")


@query(f"WITH {GRID}, {_STATE}, {_FOUND} SELECT state, round(avg(CASE WHEN found = state THEN 1.0 ELSE 0.0 END), 6) AS recall FROM fs GROUP BY 1")
def met_state_recall(spark, sf):
    """Recall by state after the best renaming of found states, which here is the identity."""
    found = states(spark, sf).withColumn("found", F.when(F.col("day") % 5 == 0, "NORMAL").otherwise(F.col("state")))
    names = dict(evaluate.best_alignment(found, "state", "found", ["BUSY", "NORMAL", "QUIET"]))
    renamed = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("found"))
    return rounded(found.groupBy("state").agg(F.avg((renamed == F.col("state")).cast("double")).alias("recall")), "recall")


@query()
def met_perm(spark, sf):
    """Permutation null of the AUC over entities."""
    per = scored(spark, sf).groupBy("entity").agg(F.max("p").alias("score"), F.max(F.col("bad").cast("int")).alias("label"))
    per = per.withColumn("label", F.when(F.col("score") > 0.9, 1).otherwise(F.col("entity").cast("int") % 2))
    return rounded(evaluate.permutation_null(per, 499, 5), "auc")


@query("SELECT l_suppkey, round(sum(l_extendedprice) / 2400 * 30, 2) AS monthly, round(0.001 * (sum(l_extendedprice) / 2400) * 30, 6) AS lifetime, round(0.05 * 1.35 * sum(l_extendedprice), 2) AS realised FROM lineitem GROUP BY 1")
def dec_values(spark, sf):
    per = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("g"))
    got = per.select("l_suppkey", *[c.alias(n) for n, c in evaluate.values(F.col("g") / 2400, F.col("g")).items()])
    return rounded(rounded(got, "monthly", "realised", digits=2), "lifetime")


@query(f"WITH {_S}, {_ACT}, th AS (SELECT stratum, max(CASE WHEN r = ceil((n + 1) * 0.95) THEN p END) AS threshold FROM (SELECT stratum, p, row_number() OVER (PARTITION BY stratum ORDER BY p) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s WHERE NOT bad) GROUP BY 1) SELECT id, CASE WHEN action = 'HOLD' AND NOT coalesce(p > threshold, false) THEN 'REVIEW' ELSE action END AS final FROM d LEFT JOIN th ON d.stratum = th.stratum")
def rung6_conformal(spark, sf):
    th = decide.conformal_thresholds(scored(spark, sf).filter("not bad"), "stratum", "p", 0.05)
    return evaluate.conformal_release(decided(spark, sf), th, "stratum", "p").select("id", F.col("action").alias("final"))


@query(f"WITH {_S} SELECT id, round(CASE WHEN bad THEN least(50.0, greatest(1.0, exposure / 250.0)) ELSE 1.0 END, 6) AS weight FROM s")
def rung4_weights(spark, sf):
    return rounded(scored(spark, sf).select("id", evaluate.cost_weights(F.col("bad"), F.col("exposure")).alias("weight")), "weight")


@query()
def rung9_rank_cusum(spark, sf):
    """Normal scores within a day, accumulated by entity, blended with a score by logistic regression."""
    rows = sequences.normal_score(panel(spark, sf).select("entity", F.col("day").cast("int").alias("day"), F.col("v_gmv_z").alias("z")), ["day"], "z").fillna({"score": 0.0})
    c = sequences.page_cusum(rows, ["entity"], "day", "score").withColumnRenamed("cusum", "c")
    both = rows.join(c, ["entity", "day"]).withColumn("p", 1 / (1 + F.exp(-F.col("z").cast("double") / 5))).withColumn("label", (F.col("z") > 1).cast("double"))
    return rounded(evaluate.rank_cusum_blend(both.filter("day < 20"), both.filter("day >= 20")).select("entity", "day", "blended"), "blended", digits=4)


@query()
def rung7_hsmm(spark, sf):
    return evaluate.hsmm_states(grid(spark, sf).select("entity", "day", F.col("n").cast("int").alias("n")), "entity", "day", "n", [0.5, 2.5, 6.0])


@query(f"WITH {_S}, f AS (SELECT id, day, bad, loss, row_number() OVER (PARTITION BY day ORDER BY loss * CAST(bad AS INT) DESC, id) AS k FROM s), a AS (SELECT *, CASE WHEN bad AND k <= 3 AND loss > 250.0 / 0.8 THEN CASE WHEN 250.0 <= 250.0 + 0.2*loss THEN 'HOLD' ELSE 'REVIEW' END ELSE 'PASS' END AS action FROM f) SELECT id, action FROM a WHERE action <> 'PASS'")
def orc_actions(spark, sf):
    """Hindsight: with unit weights the best use of a day's slots is its largest losses; holding is exact and so never dearer than review."""
    k = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(F.col("loss") * F.col("bad").cast("int")), "id"))
    best = scored(spark, sf).withColumn("k", k).filter(F.col("bad") & (F.col("k") <= 3) & (F.col("loss") > 250.0 / 0.8))
    return best.select("id", F.when(F.lit(250.0) <= 250.0 + 0.2 * F.col("loss"), "HOLD").otherwise("REVIEW").alias("action"))


@query("SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR))) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE c_mktsegment = 'BUILDING' OR k <= ceil(0.25 * n)")
def spl_sample(spark, sf):
    """All of one class, a quarter of each other by hash order; sampling is the operator."""
    w = Window.partitionBy("c_mktsegment")
    k, n = F.row_number().over(w.orderBy(F.md5(F.col("c_custkey").cast("string")))), F.count(F.lit(1)).over(w)
    return t(spark, sf, "customer").withColumns({"k": k, "n": n}).filter((F.col("c_mktsegment") == "BUILDING") | (F.col("k") <= F.ceil(0.25 * F.col("n")))).select("c_custkey")


@query("SELECT o_orderkey, fold FROM (SELECT o_orderkey, CASE WHEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) < 1200 THEN 'train' ELSE 'val' END AS span, CASE WHEN o_custkey % 3 < 2 THEN 'train' ELSE 'val' END AS fold FROM orders) WHERE fold = span")
def spl_rows(spark, sf):
    """Rows whose entity fold and time span agree; the rest belong to no split."""
    span = F.when(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) < 1200, "train").otherwise("val")
    fold = F.when(F.col("o_custkey") % 3 < 2, "train").otherwise("val")
    return t(spark, sf, "orders").withColumn("fold", fold).filter(F.col("fold") == span).select("o_orderkey", "fold")


@query(f"WITH {_S}, v AS (SELECT loss, row_number() OVER (ORDER BY p DESC, id) AS by_p, row_number() OVER (ORDER BY p * exposure DESC, id) AS by_loss FROM s WHERE bad) SELECT round(sum(CASE WHEN by_p <= 50 THEN loss ELSE 0.0 END) / sum(loss), 6) AS share_p, round(sum(CASE WHEN by_loss <= 50 THEN loss ELSE 0.0 END) / sum(loss), 6) AS share_loss FROM v")
def srt_share_topk(spark, sf):
    """Share of all losses among the 50 best by two estimators, by distributed top-k."""
    bad = scored(spark, sf).filter("bad").select("id", "p", "exposure", "loss")
    total = bad.agg(F.sum("loss")).first()[0] or 1.0
    head = lambda order, name: bad.orderBy(F.desc(order), "id").limit(50).agg((F.sum("loss") / total).alias(name))
    a, b = head(F.col("p"), "share_p").withColumn("one", F.lit(1)), head(F.col("p") * F.col("exposure"), "share_loss").withColumn("one", F.lit(1))
    return rounded(a.join(b, "one").drop("one"), "share_p", "share_loss")


@query(f"WITH {GRID}, v AS (SELECT entity, day, sum(n) {frame(7)} AS n7, coalesce(sum(n) {frame(14, 7)}, 0) / 2.0 AS base, (sum(refunds) {frame(30)}) / greatest(1, sum(n) {frame(30)}) AS rr FROM grid) SELECT entity, min(CASE WHEN (base > 0 AND n7 >= 3 * base) OR rr > 0.35 THEN day END) AS flag_day, round(max(least(2.0, CASE WHEN base > 0 THEN n7 / (3 * base) ELSE 0.0 END)) / 2, 6) + 0.0 AS score FROM v GROUP BY 1")
def g2_rules(spark, sf):
    """Velocity against a trailing base and refund share; the first day any rule fires, and the clipped top severity."""
    n7, base = F.sum("n").over(trailing(7)), F.coalesce(F.sum("n").over(trailing(14, 7)), F.lit(0)) / 2
    rr = F.sum("refunds").over(trailing(30)) / F.greatest(F.lit(1), F.sum("n").over(trailing(30)))
    v = grid(spark, sf).select("entity", "day", n7.alias("n7"), base.alias("base"), rr.alias("rr"))
    fires = ((F.col("base") > 0) & (F.col("n7") >= 3 * F.col("base"))) | (F.col("rr") > 0.35)
    severity = F.least(F.lit(2.0), daily.ratio(F.col("n7"), 3 * F.col("base")))
    return rounded(v.groupBy("entity").agg(F.min(F.when(fires, F.col("day"))).alias("flag_day"), (F.max(severity) / 2).alias("score")), "score")


@query(f"""WITH {GRID}, t1 AS (SELECT entity, day, {FEATURE_SQL['v_txn_count_z']} AS a, {FEATURE_SQL['v_gmv_z']} AS b FROM grid), s AS (SELECT entity, day, round(greatest(abs(a), abs(b)), 6) + 0.0 AS screen FROM t1 WHERE day = 25),
  r AS (SELECT *, row_number() OVER (ORDER BY screen DESC, entity) AS k, count(*) OVER () AS n FROM s) SELECT entity, screen FROM r WHERE k <= least(n, greatest(1, round_even(n * 0.1, 0)))""")
def cascade_screen(spark, sf):
    """Stage 0 for all entities of a day, the top tenth promoted; stage 1 reads only those, by a semi-join."""
    screen = rounded(panel(spark, sf).filter("day = 25").select("entity", F.greatest(F.abs("v_txn_count_z"), F.abs("v_gmv_z")).alias("screen")), "screen").withColumnRenamed("entity", "id")
    return decide.promote(screen, "screen").withColumnRenamed("id", "entity")


@query("SELECT status, name, round(value, 4) AS value FROM (SELECT o_orderstatus AS status, avg(o_totalprice) AS mean, max(o_totalprice) AS top FROM orders GROUP BY 1) UNPIVOT (value FOR name IN (mean, top))")
def rep_sweep_long(spark, sf):
    per = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"))
    return rounded(per.unpivot("status", ["mean", "top"], "name", "value"), "value", digits=4)


@query("WITH s AS (SELECT o_orderpriority AS policy, year(o_orderdate) AS seed, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2) SELECT policy, round(avg(x), 4) AS mean, round(min(x), 4) AS low, round(max(x), 4) AS high, count(*) FILTER (x > 100000) AS passing FROM s GROUP BY 1")
def agg_pooled(spark, sf):
    """Mean, range and number of seeds that pass a bar, per policy."""
    s = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("policy"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("x"))
    return rounded(s.groupBy("policy").agg(F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("x") > 100000).alias("passing")), "mean", "low", "high", digits=4)


@query("WITH k AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS ordinal FROM k")
def scr_drop_censored(spark, sf):
    """Bags left after censoring, numbered densely anew within their supplier."""
    kept = t(spark, sf, "lineitem").filter("l_returnflag <> 'R'")
    return kept.select("l_orderkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")).cast("bigint").alias("ordinal"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 10")
def scr_attention_topk(spark, sf):
    """Ten heaviest instances of each bag; the rank limit prunes before the shuffle."""
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").withColumn("k", k).filter("k <= 10").select("l_orderkey", "l_linenumber")


@query(f"WITH {EV}, w AS (SELECT DISTINCT entity, counterparty, CAST(floor(day / 7.0) AS INT) AS week FROM ev WHERE counterparty IS NOT NULL) SELECT a.entity, a.week, count(*) AS staying FROM w a JOIN w b ON a.entity = b.entity AND a.counterparty = b.counterparty AND a.week = b.week + 1 GROUP BY 1, 2")
def join_adjacent(spark, sf):
    """Counterparties met in two weeks running, by a lag over distinct cells instead of a self-join."""
    cells = payers.weekly(events(spark, sf)).filter("counterparty is not null").select("entity", "counterparty", "week").distinct()
    was = F.lag("week").over(Window.partitionBy("entity", "counterparty").orderBy("week"))
    return cells.withColumn("was", was).filter(F.col("was") == F.col("week") - 1).groupBy("entity", "week").agg(F.count(F.lit(1)).alias("staying"))


@query(f"WITH {GRID}, r AS (SELECT entity, day, CASE WHEN day < 5 + entity % 10 THEN 'HEALTHY' WHEN day < 9 + entity % 10 THEN 'RAMP' ELSE 'BAD' END AS phase FROM grid) SELECT entity, phase, count(*) AS days FROM r GROUP BY 1, 2")
def scr_reference_path(spark, sf):
    """Days by phase from an onset and a ramp length."""
    onset = 5 + F.col("entity") % 10
    phase = F.when(F.col("day") < onset, "HEALTHY").when(F.col("day") < onset + 4, "RAMP").otherwise("BAD")
    return grid(spark, sf).groupBy("entity", phase.alias("phase")).agg(F.count(F.lit(1)).alias("days"))


@query("SELECT policy, round(savings - floor, 6) + 0.0 AS margin FROM (SELECT o_orderpriority AS policy, avg(o_totalprice) / 150000 AS savings, min(avg(o_totalprice)) OVER () / 150000 AS floor FROM orders GROUP BY 1)")
def rep_derive(spark, sf):
    """Each policy's margin over the floor; a row per policy reaches the window."""
    per = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("policy")).agg((F.avg("o_totalprice") / 150000).alias("s"))
    return rounded(per.select("policy", (F.col("s") - F.min("s").over(Window.partitionBy(F.lit(1)))).alias("margin")), "margin")


@query("WITH c AS (SELECT user_id AS entity, ts, value FROM events) SELECT entity, epoch_us(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2024-01-01')) AS start_us, count(*) AS n FROM c GROUP BY 1, 2")
def win_tumbling(spark, sf):
    """Seven-day tumbling windows anchored at a Monday."""
    per = events(spark, sf).groupBy("entity", F.window("time", "7 days", startTime="4 days").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("entity", F.unix_micros("w.start").alias("start_us"), "n")


@query(f"WITH {EV}, g AS (SELECT entity, t, CASE WHEN epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY entity ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS new_ FROM ev), s AS (SELECT entity, t, sum(new_) OVER (PARTITION BY entity ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT entity, epoch_us(min(t)) AS start_us, count(*) AS n FROM s GROUP BY entity, k")
def win_session(spark, sf):
    """Sessions that end after six quiet hours."""
    per = events(spark, sf).groupBy("entity", F.session_window("time", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("entity", F.unix_micros("w.start").alias("start_us"), "n")


@query()
def gen_events(spark, sf):
    """The stream generator, rolled by entity and day."""
    return daily.day_roll(generate.events(spark, 50, 30))


def queries():
    return OUT


def oracle_sql():
    return SQL
