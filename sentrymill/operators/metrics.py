"""Ranking, calibration, cost and detection metrics. Undefined values are null.

Running sums over all rows are taken in ranges of the score, between cuts that are its
approximate quantiles, and offset by the totals of the ranges below; no task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cuts between ranges; so many numbers come to the driver.
CUTS = 200


def cumulated(rows: DataFrame, key: str, *columns: str, tie: str | None = None) -> DataFrame:
    """rows with upto_x and all_x for each column x: its sum over rows up to this one by key (then tie), and over all rows.

    key has no nulls; it is distinct, or tie decides. A row for each range is broadcast.
    """
    ranges = min(CUTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []))
    at = sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    cut = rows.withColumn("__range", at)
    totals = rows.groupBy(at.alias("__of")).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    line = Window.partitionBy(F.lit(1)).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    below = totals.select("__of", *[F.coalesce(F.sum(f"__{c}").over(line), F.lit(0)).alias(f"__below_{c}") for c in columns], *[F.sum(f"__{c}").over(Window.partitionBy(F.lit(1))).alias(f"all_{c}") for c in columns])
    own = Window.partitionBy("__range").orderBy(key, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"__own_{c}": F.sum(c).over(own) for c in columns}).join(F.broadcast(below), F.col("__range") == F.col("__of"))
    return out.withColumns({f"upto_{c}": F.col(f"__below_{c}") + F.col(f"__own_{c}") for c in columns}).drop("__range", "__of", *[f"__{k}_{c}" for k in ("own", "below") for c in columns])


def by_score(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg) per distinct score."""
    return rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def pr_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: average precision with tied scores grouped; null with one class alone."""
    cum = cumulated(by_score(rows.filter(F.col(score).isNotNull()), score, label), "score", "pos", "neg")
    tp, fp = (F.col(f"all_{c}") - F.col(f"upto_{c}") + F.col(c) for c in ("pos", "neg"))
    out = cum.agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / F.col("p")).alias("pr_auc"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: Mann-Whitney with ties at half."""
    cum = cumulated(by_score(rows.filter(F.col(score).isNotNull()), score, label), "score", "neg")
    out = cum.agg(F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).alias("roc_auc"))


def ece(rows: DataFrame, score: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal-mass bins, the first of which take the remainder."""
    ranked = cumulated(rows.select(F.col(score).alias("p"), F.col(label).cast("double").alias("y"), F.col(tie).alias("tie"), F.lit(1).alias("one")).filter("p is not null"), "p", "one", tie="tie")
    least, extra, k = F.floor(F.col("all_one") / bins), F.col("all_one") % bins, F.col("upto_one") - 1
    b = F.when(k < extra * (least + 1), F.floor(k / (least + 1))).otherwise(extra + F.floor((k - extra * (least + 1)) / F.greatest(least, F.lit(1))))
    per = ranked.withColumn("b", b).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame, score: str, label: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return rows.agg(F.avg(d * d).alias("brier"))


def time_to_detect(alerts: DataFrame, onsets: DataFrame) -> DataFrame:
    """(entity, onset, ttd): first alert on or after onset less onset, null if never. alerts: entity, day."""
    first = alerts.join(onsets, "entity").filter(F.col("day") >= F.col("onset")).groupBy("entity").agg(F.min("day").alias("d"))
    return onsets.join(first, "entity", "left").select("entity", "onset", (F.col("d") - F.col("onset")).alias("ttd"))


def detection_rates(ttd: DataFrame, last_day: int, horizons: tuple = (7, 14, 30)) -> DataFrame:
    """One row: share detected within each horizon among those observable that long."""
    seen = F.lit(last_day) - F.col("onset")
    return ttd.agg(*[(F.count_if((seen >= h) & (F.col("ttd") <= h)) / F.nullif(F.count_if(seen >= h), F.lit(0))).alias(f"within_{h}") for h in horizons])


def alert_jaccard(alerts: DataFrame) -> DataFrame:
    """One row: mean overlap of adjacent weeks' sets of alerted entities, by counts; no sets are collected."""
    weeks = alerts.select("entity", F.floor(F.col("day") / 7).cast("int").alias("week")).distinct()
    order = Window.partitionBy("entity").orderBy("week")
    marked = weeks.withColumn("stays", F.lag("week").over(order) == F.col("week") - 1)
    per = marked.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.count_if("stays").alias("common"))
    line = Window.partitionBy(F.lit(1)).orderBy("week")
    pairs = per.withColumn("was", F.when(F.lag("week").over(line) == F.col("week") - 1, F.lag("n").over(line))).filter("was is not null")
    return pairs.agg(F.avg(F.col("common") / (F.col("n") + F.col("was") - F.col("common"))).alias("jaccard"))


def ks_uniform(rows: DataFrame, column: str) -> DataFrame:
    """One row: largest gap between the column's distribution and the uniform one on [0, 1]."""
    cum = cumulated(rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("k")), "x", "k")
    c, n = F.col("upto_k"), F.col("all_k")
    return cum.agg(F.max(F.greatest(c / n - F.col("x"), F.col("x") - (c - F.col("k")) / n)).alias("d"))


def ks_two(rows: DataFrame, column: str, side: str) -> DataFrame:
    """One row: largest gap between the column's distributions on the two sides (boolean)."""
    per = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    return cumulated(per, "x", "a", "b").agg(F.max(F.abs(F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b"))).alias("d"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of average ranks."""
    out = rows
    for c in (a, b):
        per = cumulated(rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k")), c, "k")
        out = out.join(per.select(F.col(c), (F.col("upto_k") - F.col("k") + (F.col("k") + 1) / 2).alias(f"__{c}")), c)
    return out.agg(F.corr(f"__{a}", f"__{b}").alias("rho"))


def best(rows: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k rows of largest score, ties by tie: all above the k-th score, and as many of those that share it as are left.

    Only the rows that share the k-th score are ranked.
    """
    per = cumulated(rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("x")).agg(F.count(F.lit(1)).alias("n")), "x", "n")
    above = F.col("all_n") - F.col("upto_n")
    at = per.filter((above < k) & (above + F.col("n") >= k)).select("x", above.alias("above")).first()
    if at is None:
        return rows.filter(F.col(score).isNotNull())
    return rows.filter(F.col(score) > F.lit(at["x"])).unionByName(rows.filter(F.col(score) == F.lit(at["x"])).orderBy(tie).limit(k - at["above"]))
