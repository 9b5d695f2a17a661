"""Decisions, metrics, models and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import daily, decide, metrics, models
from ..roles import bound, events_roles
from ..session import shared_folder
from ..streaming import online
from ..functions.scalars import wilson
from . import features
from .features import EV, GRID, SQL as FEATURE_SQL, events, panel, rounded

FEATURES, ORACLES = features.queries(), features.oracle_sql()
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


#: A scored table over orders: p from the price, exposure from it too, bad by status, a loss where bad.
_S = "s AS (SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, least(CAST(1 AS DOUBLE), o_totalprice / 400000.0) AS p, o_totalprice / 3.5 AS exposure, o_orderstatus = 'F' AS bad, o_totalprice / 3 AS loss, o_orderpriority AS stratum, o_custkey AS entity FROM orders)"
_COST = "SELECT *, p*exposure AS c0, 250.0 + 0.2*p*exposure AS c1, 250.0 + (1-p)*8000.0 AS c2 FROM s"
_ACT = f"c AS ({_COST}), b AS (SELECT *, c0 - least(c1, c2) AS benefit FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY benefit DESC, id) AS k FROM b), d AS (SELECT *, CASE WHEN benefit <= 0 OR k > 3 THEN 'PASS' WHEN c2 < c1 AND p >= 0.9 AND p*exposure >= 25000 THEN 'HOLD' ELSE 'REVIEW' END AS action FROM r)"
_PAID = "CASE action WHEN 'PASS' THEN CASE WHEN bad THEN loss ELSE 0.0 END WHEN 'REVIEW' THEN CASE WHEN bad THEN 250.0 + 0.2*loss ELSE 250.0 END ELSE CASE WHEN bad THEN 250.0 ELSE 8250.0 END END"


def scored(spark, sf):
    price = F.col("o_totalprice")
    return t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"), F.least(F.lit(1.0), price / 400000.0).alias("p"),
        (price / 3.5).alias("exposure"), (F.col("o_orderstatus") == "F").alias("bad"), (price / 3).alias("loss"), F.col("o_orderpriority").alias("stratum"), F.col("o_custkey").alias("entity"),
    )


def decided(spark, sf):
    return decide.select_actions(scored(spark, sf), capacity=3)


@query(f"WITH {_S}, c AS ({_COST}) SELECT id, round(c0, 4) + 0.0 AS c0, round(c1, 4) + 0.0 AS c1, round(c2, 4) + 0.0 AS c2 FROM c")
def dec_cost(spark, sf):
    s = scored(spark, sf)
    c = decide.expected_costs(F.col("p"), F.col("exposure"))
    return rounded(s.select("id", c["PASS"].alias("c0"), c["REVIEW"].alias("c1"), c["HOLD"].alias("c2")), "c0", "c1", "c2", digits=4)


@query(f"WITH {_S}, {_ACT} SELECT id, day, action FROM d")
def dec_select(spark, sf):
    return decided(spark, sf).select("id", "day", "action")


@query(f"WITH {_S}, c AS ({_COST}) SELECT id, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 'PASS' WHEN c1 <= c2 THEN 'REVIEW' ELSE 'HOLD' END AS action FROM c")
def dec_bmr(spark, sf):
    return scored(spark, sf).select("id", decide.bayes_minimum_risk(F.col("p"), F.col("exposure")).alias("action"))


@query(f"WITH {_S}, {_ACT} SELECT round(1 - sum({_PAID}) / sum(CASE WHEN bad THEN loss ELSE 0.0 END), 6) AS savings, round(sum({_PAID}), 2) AS cost, round(sum(CASE WHEN bad THEN loss ELSE 0.0 END), 2) AS lost FROM d")
def met_savings(spark, sf):
    return rounded(rounded(decide.savings(decided(spark, sf)), "savings"), "cost", "lost", digits=2)


_RATIOS = "(VALUES (0.01), (0.1), (1.0), (10.0)) AS q(ratio)"


@query(f"WITH {_S}, m AS (SELECT avg(loss) AS fl FROM s WHERE bad), g AS (SELECT ratio, CAST(ratio AS DOUBLE) * fl AS hold FROM {_RATIOS}, m) SELECT CAST(ratio AS DOUBLE) AS ratio, round(sum(least(p*exposure, 250.0 + 0.2*p*exposure, 250.0 + (1-p)*hold)), 2) AS cost FROM s, g GROUP BY ratio")
def dec_sweep(spark, sf):
    """Total least expected cost at several false-hold costs: one pass with a sum per ratio, no row is multiplied."""
    s, ratios = scored(spark, sf), (0.01, 0.1, 1.0, 10.0)
    mean = s.filter("bad").agg(F.avg("loss")).first()[0] or 0.0
    total = lambda r: F.sum(F.least(F.col("p") * F.col("exposure"), 250.0 + 0.2 * F.col("p") * F.col("exposure"), 250.0 + (1 - F.col("p")) * (r * mean)))
    wide = s.agg(F.array(*[F.struct(F.lit(r).alias("ratio"), total(r).alias("cost")) for r in ratios]).alias("a"))
    return rounded(wide.select(F.inline("a")), "cost", digits=2)


@query(f"WITH {_S}, f AS (SELECT 'all_pass' AS policy, sum(CASE WHEN bad THEN loss ELSE 0.0 END) AS cost FROM s UNION ALL SELECT 'all_hold', sum(CASE WHEN bad THEN 250.0 ELSE 8250.0 END) FROM s UNION ALL SELECT 'volume_rank', sum(CASE WHEN k <= 3 THEN CASE WHEN bad THEN 250.0 + 0.2*loss ELSE 250.0 END WHEN bad THEN loss ELSE 0.0 END) FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY exposure DESC, id) AS k FROM s)) SELECT policy, round(cost, 2) AS cost FROM f")
def met_floors(spark, sf):
    """Costs of the floors that any model must beat; all come from one scan."""
    k = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("exposure"), "id"))
    s = scored(spark, sf).withColumn("k", k)
    cost = lambda action: F.sum(decide.realised_cost(action, F.col("bad"), F.col("loss")))
    wide = s.agg(cost(F.lit("PASS")).alias("all_pass"), cost(F.lit("HOLD")).alias("all_hold"), cost(F.when(F.col("k") <= 3, "REVIEW").otherwise("PASS")).alias("volume_rank"))
    return rounded(wide.unpivot([], ["all_pass", "all_hold", "volume_rank"], "policy", "cost"), "cost", digits=2)


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k, count(*) OVER () AS n FROM s) SELECT id FROM r WHERE k <= least(n, greatest(1, round_even(n * 0.10, 0)))")
def srt_promote(spark, sf):
    return decide.promote(scored(spark, sf), "p").select("id")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, [struct_pack(s := -abs(l_quantity - 25), i := 0, n := 'quantity'), struct_pack(s := -abs(l_discount * 500 - 25), i := 1, n := 'discount'), struct_pack(s := -abs(l_tax * 500 - 20), i := 2, n := 'tax'), struct_pack(s := -abs(l_linenumber * 5.0 - 15), i := 3, n := 'line')] AS a FROM lineitem) SELECT l_orderkey, l_linenumber, list_sort(a)[1].n || ',' || list_sort(a)[2].n || ',' || list_sort(a)[3].n AS reasons FROM x")
def srt_reason_topk(spark, sf):
    parts = {"quantity": F.col("l_quantity") - 25, "discount": F.col("l_discount") * 500 - 25, "tax": F.col("l_tax") * 500 - 20, "line": F.col("l_linenumber") * 5.0 - 15}
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(decide.reasons(parts), ",").alias("reasons"))


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k FROM s) SELECT round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 6) AS precision_at_k FROM r WHERE k <= 100")
def srt_precision_k(spark, sf):
    return rounded(scored(spark, sf).orderBy(F.desc("p"), "id").limit(100).agg(F.avg(F.col("bad").cast("double")).alias("precision_at_k")), "precision_at_k")


@query("WITH v AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, o_custkey) AS k, count(*) OVER () AS n, sum(v) OVER () AS tot FROM v) SELECT round(sum(v) / max(tot), 6) AS share FROM r WHERE k <= ceil(0.1 * n)")
def srt_top_decile(spark, sf):
    """Share held by the largest tenth of per-entity totals; only ties at the cut are ranked."""
    per = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    n, total = per.agg(F.count(F.lit(1)), F.sum("v")).first()
    head = metrics.best(per, "v", -(-n // 10), "o_custkey")
    return rounded(head.agg((F.sum("v") / F.lit(float(total or 1))).alias("share")), "share")


@query(f"WITH {_S}, {_ACT} SELECT id FROM (SELECT id, c0 - c1 AS regret, row_number() OVER (PARTITION BY day ORDER BY c0 - c1 DESC, id) AS q FROM d WHERE action = 'REVIEW') WHERE q <= 2")
def srt_capacity_regret(spark, sf):
    """Of each day's reviews the two that would cost most if passed."""
    c = decide.expected_costs(F.col("p"), F.col("exposure"))
    q = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(c["PASS"] - c["REVIEW"]), "id"))
    return decided(spark, sf).filter("action = 'REVIEW'").withColumn("q", q).filter("q <= 2").select("id")


@query(f"WITH {_S}, n AS (SELECT stratum, p, row_number() OVER (PARTITION BY stratum ORDER BY p) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s WHERE NOT bad) SELECT stratum, round(max(CASE WHEN r = ceil((n + 1) * (1 - 0.05)) THEN p END), 6) AS threshold FROM n GROUP BY 1")
def dec_conformal(spark, sf):
    return rounded(decide.conformal_thresholds(scored(spark, sf).filter("not bad"), "stratum", "p", 0.05), "threshold")


@query(f"WITH {_S}, {_ACT} SELECT stratum, count(*) FILTER (NOT bad AND action = 'HOLD') AS held, count(*) FILTER (NOT bad) AS n, round(count(*) FILTER (NOT bad AND action <> 'PASS') / count(*) FILTER (NOT bad), 6) AS rate FROM d GROUP BY 1")
def met_coverage(spark, sf):
    ok = ~F.col("bad")
    return rounded(decided(spark, sf).groupBy("stratum").agg(F.count_if(ok & (F.col("action") == "HOLD")).alias("held"), F.count_if(ok).alias("n"), (F.count_if(ok & (F.col("action") != "PASS")) / F.count_if(ok)).alias("rate")), "rate")


_G = "g AS (SELECT p AS score, count(*) FILTER (bad) AS pos, count(*) FILTER (NOT bad) AS neg FROM s GROUP BY 1)"


def labelled(spark, sf):
    return scored(spark, sf).select("id", F.col("p").alias("score"), F.col("bad").cast("int").alias("label"))


@query(f"WITH {_S}, {_G}, c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos + neg) OVER (ORDER BY score DESC) AS seen FROM g) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS pr_auc FROM c")
def met_pr_auc(spark, sf):
    return rounded(metrics.pr_auc(labelled(spark, sf)), "pr_auc")


@query(f"WITH {_S}, {_G}, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM g) SELECT round(sum(pos * (under + neg / 2.0)) / sum(pos) / sum(neg), 6) AS roc_auc FROM c")
def met_roc_auc(spark, sf):
    return rounded(metrics.roc_auc(labelled(spark, sf)), "roc_auc")


@query(f"WITH {_S}, b AS (SELECT p, CAST(bad AS INT) AS y, ntile(10) OVER (ORDER BY p, id) AS b FROM s), q AS (SELECT b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM q")
def met_ece(spark, sf):
    return rounded(metrics.ece(labelled(spark, sf), "score", "label", "id"), "ece")


@query(f"WITH {_S} SELECT round(avg((p - CAST(bad AS INT)) * (p - CAST(bad AS INT))), 6) AS brier FROM s")
def met_brier(spark, sf):
    return rounded(metrics.brier(labelled(spark, sf), "score", "label"), "brier")


@query(f"WITH {_S}, {_ACT} SELECT round(count(*) FILTER (action <> 'PASS' AND bad) / count(*) FILTER (action <> 'PASS'), 6) AS precision_, round(count(*) FILTER (action <> 'PASS' AND bad) / count(*) FILTER (bad), 6) AS recall, round(count(*) FILTER (action <> 'PASS') / count(DISTINCT day), 6) AS alerts_per_day FROM d")
def met_pr_at_k(spark, sf):
    alert = F.col("action") != "PASS"
    out = decided(spark, sf).agg((F.count_if(alert & F.col("bad")) / F.count_if(alert)).alias("precision_"), (F.count_if(alert & F.col("bad")) / F.count_if("bad")).alias("recall"), (F.count_if(alert) / F.countDistinct("day")).alias("alerts_per_day"))
    return rounded(out, "precision_", "recall", "alerts_per_day")


_TTD = f"{_S}, {_ACT}, o AS (SELECT entity, CAST(min(day) AS INT) AS onset FROM s WHERE bad GROUP BY 1), a AS (SELECT entity, day FROM d WHERE action <> 'PASS'), f AS (SELECT a.entity, min(day) AS d FROM a JOIN o ON a.entity = o.entity WHERE day >= onset GROUP BY 1), ttd AS (SELECT o.entity, onset, d - onset AS ttd FROM o LEFT JOIN f ON o.entity = f.entity)"


def _detected(spark, sf):
    d = decided(spark, sf)
    return metrics.time_to_detect(d.filter("action <> 'PASS'").select("entity", "day"), d.filter("bad").groupBy("entity").agg(F.min("day").alias("onset")))


@query(f"WITH {_TTD} SELECT entity, onset, ttd FROM ttd")
def met_ttd(spark, sf):
    return _detected(spark, sf)


@query(f"WITH {_TTD} SELECT round(count(*) FILTER (2400 - onset >= 7 AND ttd <= 7) / count(*) FILTER (2400 - onset >= 7), 6) AS within_7, round(count(*) FILTER (2400 - onset >= 14 AND ttd <= 14) / count(*) FILTER (2400 - onset >= 14), 6) AS within_14, round(count(*) FILTER (2400 - onset >= 30 AND ttd <= 30) / count(*) FILTER (2400 - onset >= 30), 6) AS within_30 FROM ttd")
def met_detect_rate(spark, sf):
    return rounded(metrics.detection_rates(_detected(spark, sf), 2400), "within_7", "within_14", "within_30")


@query(f"WITH {_S}, {_ACT}, w AS (SELECT DISTINCT entity, CAST(floor(day / 7.0) AS INT) AS week FROM d WHERE action <> 'PASS'), n AS (SELECT week, count(*) AS n FROM w GROUP BY 1), cm AS (SELECT e.week, count(*) AS m FROM w v JOIN w e ON v.entity = e.entity AND v.week = e.week - 1 GROUP BY 1) SELECT round(avg(coalesce(m, 0) / (y.n + x.n - coalesce(m, 0))), 6) AS jaccard FROM n y JOIN n x ON x.week = y.week - 1 LEFT JOIN cm ON cm.week = y.week")
def met_jaccard(spark, sf):
    return rounded(metrics.alert_jaccard(decided(spark, sf).filter("action <> 'PASS'")), "jaccard")


@query(f"WITH {_S}, g AS (SELECT p AS x, count(*) AS k FROM s GROUP BY 1), c AS (SELECT x, k, sum(k) OVER (ORDER BY x) AS c, sum(k) OVER () AS n FROM g) SELECT round(max(greatest(c / n - x, x - (c - k) / n)), 6) AS d FROM c")
def met_ks_unif(spark, sf):
    return rounded(metrics.ks_uniform(scored(spark, sf), "p"), "d")


@query(f"WITH {_S}, g AS (SELECT p AS x, count(*) FILTER (bad) AS a, count(*) FILTER (NOT bad) AS b FROM s GROUP BY 1), c AS (SELECT abs((sum(a) OVER (ORDER BY x)) / (sum(a) OVER ()) - (sum(b) OVER (ORDER BY x)) / (sum(b) OVER ())) AS gap FROM g) SELECT round(max(gap), 6) AS d FROM c")
def met_ks_two(spark, sf):
    return rounded(metrics.ks_two(scored(spark, sf), "p", "bad"), "d")


@query(f"WITH {_S}, g AS (SELECT stratum, count(*) AS n, count(*) FILTER (bad) AS k FROM s GROUP BY 1), c AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g) SELECT stratum, round(greatest(0.0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1.0, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM c")
def met_wilson(spark, sf):
    per = scored(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(per.select("stratum", low.alias("low"), high.alias("high")), "low", "high")


_R = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(f"WITH r AS (SELECT {_R.format(c='l_quantity')} AS a, {_R.format(c='l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r")
def met_spearman(spark, sf):
    return rounded(metrics.spearman(t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), "rho")


@query("WITH m AS (SELECT l_shipdate, l_returnflag, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount END AS x FROM lineitem) SELECT l_returnflag, round(median(x), 6) AS mid, count(*) - count(x) AS missing, round(min(x), 6) AS low, round(max(x), 6) AS high FROM m GROUP BY 1")
def agg_multi_seed(spark, sf):
    """Median, range and census of missing values per group."""
    x = F.when(F.col("l_discount") > 0.08, None).otherwise(F.col("l_discount"))
    per = t(spark, sf, "lineitem").withColumn("x", x).groupBy("l_returnflag")
    return rounded(per.agg(F.percentile("x", 0.5).alias("mid"), (F.count(F.lit(1)) - F.count("x")).alias("missing"), F.min("x").alias("low"), F.max("x").alias("high")), "mid", "low", "high")


@query("SELECT year(o_orderdate) AS y, round((sum(o_totalprice) - lag(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate))) / lag(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate)), 6) AS gain FROM orders GROUP BY 1")
def rep_ablation(spark, sf):
    """Relative gain of each rung (here a year) over the one before; a row per rung reaches the window."""
    per = t(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    before = F.lag("v").over(Window.partitionBy(F.lit(1)).orderBy("y"))
    return rounded(per.select("y", ((F.col("v") - before) / before).alias("gain")), "gain")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def rep_typology(spark, sf):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    per = t(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", list(names)).agg(F.count(F.lit(1)))
    return per.select("o_orderstatus", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in names.items()])


_INST = "i AS (SELECT l_suppkey, l_shipdate, l_quantity / 50 AS p FROM lineitem)"


@query(f"WITH {_INST} SELECT l_suppkey, round(avg(p), 6) AS mean, round(max(p), 6) AS max, round(CASE WHEN max(p) >= 1 THEN 1.0 ELSE 1 - exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END)) END, 6) + 0.0 AS noisy_or, round(ln(avg(exp(4.0 * p))) / 4.0, 6) AS lse FROM i GROUP BY 1")
def rung5_pooling(spark, sf):
    inst = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("p"))
    return rounded(models.pool(inst, ["l_suppkey"], "p"), "mean", "max", "noisy_or", "lse")


def _ramp(x, threshold, scale, weight):
    return f"{weight} * least(1.0, greatest(0.0, (({x}) - {threshold}) / {scale}))"


#: The twelve rules as the survey states them, apart from the operator's own table; their weights add up to 8.5.
_RULES = [
    ("v_gmv_z", 3, 3, 1.0), ("v_txn_count_z", 3, 3, 0.8), ("f_auth_fail_rate_z", 3, 3, 1.0), ("d_refund_rate_z", 3, 3, 0.9), ("v_dormant_burst", 3, 3, 0.7), ("t_micro_share", 0.05, 0.2, 0.9),
    ("t_round_amount_share", 0.05, 0.2, 0.6), ("i_intl_share", 0.3, 0.3, 0.6), ("v_gmv_accel", 2, 3, 0.5), ("h_weekend_share_z", 3, 3, 0.3),
]
_GRID_RULES = " + ".join(_ramp(FEATURE_SQL[c], *r) for c, *r in _RULES)


@query(f"WITH {GRID}, g AS (SELECT entity, day, {_GRID_RULES} AS x FROM grid), a AS ({ORACLES['v_declared_ratio']}), b AS ({ORACLES['i_mix_jsd']}) SELECT g.entity, g.day, round((x + {_ramp('v_declared_ratio', 4, 4, 0.8)} + {_ramp('i_mix_jsd', 0.5, 0.4, 0.4)}) / 8.5, 5) + 0.0 AS score FROM g JOIN a USING (entity, day) JOIN b USING (entity, day)")
def rung1_rules(spark, sf):
    """Twelve weighted ramps; declared volume and the mix's divergence join the day panel by its own key."""
    rows = panel(spark, sf)
    for name in ("v_declared_ratio", "i_mix_jsd"):
        rows = rows.join(FEATURES[name](spark, sf), ["entity", "day"])
    return rounded(rows.select("entity", "day", models.rule_score().alias("score")), "score", digits=5)


@query()
def rung2_gbt(spark, sf):
    """Boosted trees over panel features, fitted on the days before 20; every day is scored. The label is a busy next day. Learners differ, so only rows are compared."""
    names = ["v_txn_count_z", "v_gmv_z", "v_fano_trailing", "t_micro_share", "i_intl_share", "d_refund_rate_z"]
    nxt = F.lead("n").over(Window.partitionBy("entity").orderBy("day"))
    rows = panel(spark, sf).withColumn("label", F.when(nxt > 3, 1.0).otherwise(0.0))
    model = models.gbt(rows.filter("day < 20"), names, "label")
    return model.transform(rows).select("entity", "day", "prediction")


@query()
def g2_hmm_score(spark, sf):
    rows = daily.grid(daily.day_roll(events(spark, sf)), daily.last_day(events(spark, sf))).select("entity", "day", F.col("n").cast("double").alias("x"))
    return rounded(models.hmm_filter(rows, "entity", "day", "x", [2.0, 5.0], [1.5, 2.5]), "p_bad")


@query()
def rung8_residual_ks(spark, sf):
    at = events(spark, sf).select("entity", (F.unix_micros("time") / 1e6).alias("at"))
    return rounded(models.hawkes_residual_ks(at, "entity", "at"), "d")


@query()
def orc_knapsack(spark, sf):
    rows = scored(spark, sf).select("day", (F.col("id") % 5 + 1).cast("int").alias("weight"), F.col("exposure").alias("value"))
    return rounded(decide.knapsack(rows, 10), "best", digits=2)


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return bound(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder), events_roles())


@query(f"WITH {EV} SELECT entity, day, count(*) AS n, round(sum(CASE WHEN NOT failed AND NOT refund THEN amount ELSE 0.0 END), 6) + 0.0 AS gmv FROM ev GROUP BY 1, 2")
def str_daily_counts(spark, sf):
    """The day roll as a stream run to the end of what is there."""
    got = online.to_files(online.daily_counts(_stream(spark, sf)), f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}", ["entity", "start"], "update")
    return rounded(got.select("entity", F.datediff(F.to_date("start"), F.lit("2024-01-01").cast("date")).alias("day"), "n", "gmv"), "gmv")


_BASE = "n AS (SELECT entity, day, count(*) AS n FROM ev GROUP BY 1, 2), c AS (SELECT entity, day, n, avg(n) OVER (PARTITION BY entity ORDER BY day) AS mean, lead(day) OVER (PARTITION BY entity ORDER BY day) AS nxt FROM n)"


@query(f"WITH {EV}, {_BASE} SELECT entity, day, n, round(mean, 6) AS mean FROM c WHERE nxt IS NOT NULL")
def str_closed_days(spark, sf):
    """Keyed state: each entity's running mean of daily counts as its days close."""
    got = online.to_files(online.closed_days(_stream(spark, sf).select("entity", "day")), f"{shared_folder(spark)}/closed-{uuid.uuid4().hex}")
    return rounded(got, "mean")


_FLAG = f"""WITH {GRID}, z AS (SELECT entity, day, gmv, {FEATURE_SQL['v_gmv_z']} AS z FROM grid), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(z, 6) DESC, entity) AS k FROM z)
  SELECT day, count(*) FILTER (k <= 3 AND round(z, 6) > 0) AS alerts, round(sum(CASE WHEN k <= 3 AND round(z, 6) > 0 THEN gmv ELSE 0.0 END), 4) + 0.0 AS watched, round(sum(gmv), 4) + 0.0 AS gmv FROM r GROUP BY 1"""


@query(_FLAG)
def flagship(spark, sf):
    """Day roll, self-baselined volume z, top three a day, volume they cover."""
    scored_days = rounded(panel(spark, sf).select("entity", "day", "gmv", F.col("v_gmv_z").alias("z")), "z")
    k = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("z"), "entity"))
    hit = (F.col("k") <= 3) & (F.col("z") > 0)
    per = scored_days.withColumn("k", k).groupBy("day").agg(F.count_if(hit).alias("alerts"), F.sum(F.when(hit, F.col("gmv")).otherwise(0.0)).alias("watched"), F.sum("gmv").alias("gmv"))
    return rounded(per, "watched", "gmv", digits=4)


def queries():
    return OUT


def oracle_sql():
    return SQL
