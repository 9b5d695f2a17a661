"""Evaluation beyond single scores: permutation nulls, state alignment, gates, splits, decision wrappers."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def best_alignment(rows: DataFrame, truth: str, found: str, states: list) -> list[tuple]:
    """(found, truth) pairs of the one-to-one renaming with most agreement. The table has len(states)^2 cells; up to eight states are enumerated."""
    if len(states) > 8:
        raise ValueError("over eight states")
    n = {(r[truth], r[found]): r["n"] for r in contingency(rows, truth, found).collect()}
    best = max(permutations(states), key=lambda p: (sum(n.get((t, f), 0) for t, f in zip(p, states)), tuple(reversed([states.index(x) for x in p]))))
    return list(zip(states, best))


def normalised_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the mean of the entropies, from the contingency table; null if both are constant."""
    every = Window.partitionBy(F.lit(1))
    cells = contingency(rows, a, b).withColumns({"t": F.sum("n").over(every), "ra": F.sum("n").over(Window.partitionBy(a)), "rb": F.sum("n").over(Window.partitionBy(b))})
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.ln(F.col("n") * F.col("t") / F.col("ra") / F.col("rb")))
    h = lambda r: F.sum(-p * F.ln(F.col(r) / F.col("t")))
    return cells.agg(mi.alias("mi"), h("ra").alias("ha"), h("rb").alias("hb")).select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def permutation_null(rows: DataFrame, draws: int, seed: int, block: int = 100_000) -> DataFrame:
    """(draw, auc): AUC of entity scores after shuffling labels by entity; rows: score, label (0 or 1), one row per entity.

    A shuffle is known by how many positives fall on each distinct score, which is multivariate
    hypergeometric. Each draw deals its positives to blocks of about `block` distinct scores, then
    each block deals its share to its scores and gives a rank sum, so no task sees all entities and
    no entity is copied for a draw. Dealt alike on every run. Rows with a null are left out; auc is
    null with one class alone. The driver holds a number for each block; fewer than 10^9 entities.
    """
    whole = rows.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    blocks = max(1, -(-whole.agg(F.approx_count_distinct("score")).first()[0] // block))
    per = metrics.by_score(whole).withColumn("n", F.col("pos") + F.col("neg"))
    ranked = metrics.cumulated(per, "score", "n").select(
        "score", "n", "pos", (2 * F.col("upto_n") - F.col("n") + 1).alias("twice"), F.pmod(F.xxhash64("score"), F.lit(blocks)).cast("int").alias("block")
    )
    sizes = ranked.groupBy("block").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("block").collect()
    names, counts = [r["block"] for r in sizes], np.array([r["n"] for r in sizes], np.int64)
    pos = sum(r["pos"] for r in sizes)
    neg = int(counts.sum()) - pos
    each = rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    if not pos or not neg:
        return each.select("draw", F.lit(None).cast("double").alias("auc"))

    def deal(batches):
        for pdf in batches:
            for draw in pdf["draw"]:
                k = np.random.default_rng([seed, int(draw), 0]).multivariate_hypergeometric(counts, pos, method="marginals")
                yield pd.DataFrame({"draw": np.full(len(k), draw, np.int32), "block": np.array(names, np.int32), "k": k})

    def choose(cells: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("score")
        n, twice = cells["n"].to_numpy(np.int64), cells["twice"].to_numpy(np.int64)
        sums = [
            int(twice @ np.random.default_rng([seed, int(draw), 1 + int(of)]).multivariate_hypergeometric(n, int(k), method="marginals"))
            for draw, of, k in zip(dealt["draw"], dealt["block"], dealt["k"])
        ]
        return pd.DataFrame({"draw": dealt["draw"].to_numpy(np.int32), "twice": np.array(sums, np.int64)})

    dealt = each.mapInPandas(deal, "draw int, block int, k bigint")
    got = ranked.select("block", "score", "n", "twice").groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(choose, "draw int, twice bigint")
    return got.groupBy("draw").agg(((F.sum("twice") / 2 - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def onset_error(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """One row: quartiles of found - truth, their spread, and how many were not found."""
    e = F.col(found) - F.col(truth)
    q = F.percentile(e, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.agg(q.alias("q"), F.count_if(F.col(found).isNull()).alias("unlocalised"))
    return out.select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "unlocalised")


def window_excess(alerts: DataFrame, windows: DataFrame, nominal: float) -> DataFrame:
    """(name, rate, excess) of alert rates in event windows [start, end); alerts: day, alert.

    Alerts are summed by day first; days, as many as the calendar has, are what is broadcast.
    """
    days = alerts.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if("alert").alias("k"))
    joined = windows.join(F.broadcast(days), (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end")))
    return joined.groupBy("name").agg((F.sum("k") / F.sum("n")).alias("rate")).withColumn("excess", F.col("rate") - nominal)


def values(daily: Column, gross: Column) -> dict[str, Column]:
    """Monthly volume, lifetime value and realised loss of an entity under fixed rates."""
    return {"monthly": daily * 30, "lifetime": 0.001 * daily * 30, "realised": 0.05 * 1.35 * gross}


def conformal_release(decided: DataFrame, thresholds: DataFrame, stratum: str, score: str) -> DataFrame:
    """HOLD becomes REVIEW at or under the stratum's threshold, and where no bound holds."""
    joined = decided.join(thresholds, stratum, "left")
    keep = F.col("threshold").isNotNull() & (F.col(score) > F.col("threshold"))
    return joined.withColumn("action", F.when((F.col("action") == "HOLD") & ~keep, "REVIEW").otherwise(F.col("action"))).drop("threshold")


def cost_weights(bad: Column, exposure: Column, review_cost: float = 250.0) -> Column:
    """Training weight: exposure over review cost within 1..50 on positives, else 1."""
    return F.when(bad, F.least(F.lit(50.0), F.greatest(F.lit(1.0), exposure / review_cost))).otherwise(1.0)


def rank_cusum_blend(train: DataFrame, rows: DataFrame):
    """rows with blended: logistic regression on logit(p) and the accumulator c; train needs label too."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    with_logit = lambda df: df.withColumn("logit", F.ln(p / (1 - p)))
    n = max(1, train.count())
    lr = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    model = Pipeline(stages=[VectorAssembler(inputCols=["logit", "c"], outputCol="x"), lr]).fit(with_logit(train))
    return model.transform(with_logit(rows)).withColumn("blended", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction", "logit")


def hsmm_states(rows: DataFrame, key: str, order: str, x: str, means: list[float], size: float = 5.0, mean_stay: float = 10.0, longest: int = 40) -> DataFrame:
    """(key, order, state): most likely path of a semi-Markov chain with negative binomial counts and geometric-like stays up to `longest`.

    Viterbi over segment ends, in log space; memory is rows x states a key.
    """
    from math import lgamma

    k = len(means)
    stay = np.array([-d / mean_stay for d in range(1, longest + 1)])
    stay -= np.log(np.exp(stay).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        counts = pdf[x].to_numpy(int)
        like = np.array([[lgamma(c + size) - lgamma(size) - lgamma(c + 1) + size * np.log(size / (size + m)) + c * np.log(m / (size + m)) for m in means] for c in counts])
        run_sum = np.vstack([np.zeros(k), np.cumsum(like, axis=0)])
        n = len(counts)
        best, back = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k, 2), int)
        best[0] = -np.log(k)
        for end in range(1, n + 1):
            spans = np.arange(1, min(longest, end) + 1)
            for s in range(k):
                before = best[end - spans]
                others = np.where(np.arange(k)[None, :] == s, -np.inf, before) if k > 1 else before
                others[spans == end] = best[0]
                top = others.argmax(axis=1)
                score = others[np.arange(len(spans)), top] + stay[spans - 1] + run_sum[end, s] - run_sum[end - spans, s]
                at = int(score.argmax())
                best[end, s], back[end, s] = score[at], (spans[at], top[at])
        path, end, s = np.zeros(n, int), n, int(best[n].argmax())
        while end > 0:
            span, before = back[end, s]
            path[end - span : end] = s
            end, s = end - span, before
        return pd.DataFrame({key: pdf[key], order: pdf[order], "state": path})

    kinds = dict(rows.dtypes)
    return rows.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state int")
