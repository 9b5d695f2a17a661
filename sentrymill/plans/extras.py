"""Formatting, scaling, pooling and sampling operators that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate
from .decisions import _ACT, _S, decided, scored, t
from .features import EV, events, rounded

OUT: dict = {}
SQL: dict = {}


def query(sql=None):
    def add(f):
        OUT[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, 'M' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS label, regexp_replace(c_mktsegment, '^', 'seg_') AS seg, upper(substr(c_name, 1, 3)) AS head, length(c_name) AS n FROM customer")
def fn_strings(spark, sf):
    """Zero-padded ids, prefixes, slices."""
    c = t(spark, sf, "customer")
    return c.select("c_custkey", F.concat(F.lit("M"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("label"), F.concat(F.lit("seg_"), F.col("c_mktsegment")).alias("seg"), F.upper(F.substring("c_name", 1, 3)).alias("head"), F.length("c_name").cast("bigint").alias("n"))


@query("SELECT o_orderkey, isodow(o_orderdate) >= 6 AS weekend, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, strftime(o_orderdate, '%d %b %Y') AS text, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS month_s FROM orders")
def fn_dates(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    return t(spark, sf, "orders").select("o_orderkey", (F.weekday(d) >= 5).alias("weekend"), F.weekday(d).alias("weekday"), F.date_format(d, "dd MMM yyyy").alias("text"), F.unix_timestamp(F.date_trunc("month", d)).alias("month_s"))


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS a, round(log10(p_retailprice), 6) AS b, round(sqrt(p_size), 6) AS c, round(exp(-p_size / 10.0), 6) AS d, round(pow(p_size, 1.5), 6) AS e, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS f FROM part")
def fn_maths(spark, sf):
    x, s = F.col("p_retailprice"), F.col("p_size")
    got = t(spark, sf, "part").select("p_partkey", F.ln(x).alias("a"), F.log10(x).alias("b"), F.sqrt(s).alias("c"), F.exp(-s / 10).alias("d"), F.pow(s, F.lit(1.5)).alias("e"), (1 / (1 + F.exp(-(s - 25) / 10))).alias("f"))
    return rounded(got, *"abcdef")


@query("SELECT s_suppkey, printf('%s holds %.2f in nation %d', s_name, s_acctbal, s_nationkey) AS text FROM supplier")
def rep_reason_text(spark, sf):
    """Reason templates filled on the executors."""
    return t(spark, sf, "supplier").select("s_suppkey", F.format_string("%s holds %.2f in nation %d", "s_name", "s_acctbal", "s_nationkey").alias("text"))


@query("WITH i AS (SELECT l_suppkey, l_quantity / 50 AS p, l_discount * 10 AS u FROM lineitem), w AS (SELECT *, exp(u - max(u) OVER (PARTITION BY l_suppkey)) AS e FROM i) SELECT l_suppkey, round(sum(e * p) / sum(e), 6) AS pooled FROM w GROUP BY 1")
def rung5b_attention_pool(spark, sf):
    """Softmax-weighted pooling by bag, shifted by the bag's largest logit, which one more aggregate gives."""
    i = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("p"), (F.col("l_discount") * 10).alias("u"))
    e = F.exp(F.col("u") - F.col("top"))
    return rounded(i.join(i.groupBy("l_suppkey").agg(F.max("u").alias("top")), "l_suppkey").groupBy("l_suppkey").agg((F.sum(e * F.col("p")) / F.sum(e)).alias("pooled")), "pooled")


@query("WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(CASE WHEN hi > lo THEN (l_extendedprice - lo) / (hi - lo) ELSE 0.0 END, 6) AS score FROM lineitem JOIN b USING (l_returnflag)")
def prj_min_max(spark, sf):
    """Scores on [0, 1] by group: bounds are aggregated, then joined back."""
    items = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    b = items.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return rounded(items.join(b, "l_returnflag").select("l_orderkey", "l_linenumber", x.alias("score")), "score")


@query()
def src_stratified(spark, sf):
    """A fixed share of each month's rows by keyed hash order; sampling is the operator."""
    o = t(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    u = F.pmod(F.xxhash64("o_orderkey", F.lit(9)), F.lit(10_000)) / 10_000
    return o.filter(u < 0.2).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_S}, {_ACT} SELECT action, count(*) AS n, round(avg(p), 6) AS mean_p, round(min(p), 6) AS least_p FROM d GROUP BY ROLLUP (action)")
def agg_rollup(spark, sf):
    return rounded(decided(spark, sf).rollup("action").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.min("p").alias("least_p")), "mean_p", "least_p")


@query(f"WITH {_S}, v AS (SELECT p, round(p, 1) AS bar, bad, loss FROM s) SELECT round(bar, 4) AS bar, count(*) AS n, round(sum(CASE WHEN bad THEN loss ELSE 0.0 END), 2) AS lost, round(sum(sum(CASE WHEN bad THEN loss ELSE 0.0 END)) OVER (ORDER BY bar DESC), 2) AS lost_above FROM v GROUP BY bar")
def met_k2(spark, sf):
    """Losses at or above each score bar, where a margin is looked up; a row per bar reaches the window."""
    per = scored(spark, sf).groupBy(F.round("p", 1).alias("bar")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad"), F.col("loss")).otherwise(0.0)).alias("lost"))
    above = F.sum("lost").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("bar")).rowsBetween(Window.unboundedPreceding, 0))
    return rounded(per.withColumn("lost_above", above), "lost", "lost_above", digits=2)


@query(f"WITH {EV}, n AS (SELECT entity, counterparty, min(day) AS d0, max(day) AS d1, count(*) AS n FROM ev WHERE counterparty IS NOT NULL GROUP BY 1, 2) SELECT entity, round(avg(d1 - d0), 6) AS tenure, round(quantile_cont(n, 0.5), 6) AS typical, count(*) FILTER (n = 1) AS once FROM n GROUP BY 1")
def agg_tenure(spark, sf):
    per = events(spark, sf).filter("counterparty is not null").groupBy("entity", "counterparty").agg(F.min("day").alias("d0"), F.max("day").alias("d1"), F.count(F.lit(1)).alias("n"))
    return rounded(per.groupBy("entity").agg(F.avg(F.col("d1") - F.col("d0")).alias("tenure"), F.percentile("n", 0.5).alias("typical"), F.count_if(F.col("n") == 1).alias("once")), "tenure", "typical")


@query()
def met_alignment(spark, sf):
    """Renaming of found states that agrees most with the true ones, as rows."""
    both = scored(spark, sf).select(F.when(F.col("p") > 0.5, "high").otherwise("low").alias("truth"), F.when(F.col("exposure") > 60_000, "low").otherwise("high").alias("found"))
    return spark.createDataFrame(evaluate.best_alignment(both, "truth", "found", ["high", "low"]), "found string, truth string")


def queries():
    return OUT


def oracle_sql():
    return SQL
