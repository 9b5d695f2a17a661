"""Model rungs: rule ramps, gradient-boosted trees, rank accumulators, hidden Markov filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity
from ..session import shared_folder

#: Feature, threshold, scale, weight of each rule.
RULES = (
    ("v_gmv_z", 3.0, 3.0, 1.0), ("v_txn_count_z", 3.0, 3.0, 0.8), ("f_auth_fail_rate_z", 3.0, 3.0, 1.0), ("d_refund_rate_z", 3.0, 3.0, 0.9), ("v_declared_ratio", 4.0, 4.0, 0.8), ("v_dormant_burst", 3.0, 3.0, 0.7),
    ("t_micro_share", 0.05, 0.20, 0.9), ("t_round_amount_share", 0.05, 0.20, 0.6), ("i_intl_share", 0.30, 0.30, 0.6), ("v_gmv_accel", 2.0, 3.0, 0.5), ("h_weekend_share_z", 3.0, 3.0, 0.3), ("i_mix_jsd", 0.50, 0.40, 0.4),
)


def rule_score(rules=RULES) -> Column:
    """Weighted ramps over their total weight, 0 to 1; one expression, no UDF."""
    return sum((w * severity(F.col(c), t, s) for c, t, s, w in rules), F.lit(0.0)) / sum(w for *_, w in rules)


def pool(instances: DataFrame, keys: list[str], p: str, tau: float = 4.0) -> DataFrame:
    """keys with mean, max, noisy-or and log-sum-exp pooling of instance scores.

    The noisy-or of a sure instance is 1. Exponents are shifted by the bag's largest score,
    which one more aggregate gives, so that no tau overflows.
    """
    top = instances.groupBy(*keys).agg(F.max(p).alias("__top"))
    x = F.col(p)
    return instances.join(top, keys).groupBy(*keys).agg(
        F.avg(p).alias("mean"), F.max(p).alias("max"),
        F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(x < 1, F.ln(1 - x))))).alias("noisy_or"),
        (F.max("__top") + F.ln(F.avg(F.exp(tau * (x - F.col("__top"))))) / tau).alias("lse"),
    )


def gbt(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 300, depth: int = 6):
    """A fitted MLlib pipeline of boosted trees. Lineage is cut every ten trees, in the session's checkpoint folder."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    shared_folder(train.sparkSession)
    tree = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), tree.setWeightCol(weight) if weight else tree]).fit(train)


def hmm_filter(rows: DataFrame, key: str, order: str, x: str, means: list[float], sds: list[float], stay: float = 0.95, bad: int = 1) -> DataFrame:
    """(key, order, p_bad): filtered probability of the bad state of a Gaussian chain, per key in order."""
    k = len(means)
    move = np.full((k, k), (1 - stay) / max(1, k - 1))
    np.fill_diagonal(move, stay)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values = pdf[x].to_numpy(float)[:, None]
        like = -0.5 * ((values - means) / sds) ** 2 - np.log(sds)
        alpha, out = np.full(k, 1.0 / k), np.empty(len(pdf))
        for i, row in enumerate(like):
            alpha = (alpha @ move if i else alpha) * np.exp(row - row.max())
            alpha /= alpha.sum()
            out[i] = alpha[bad]
        return pd.DataFrame({key: pdf[key], order: pdf[order], "p_bad": out})

    types = dict(rows.dtypes)
    return rows.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {order} {types[order]}, p_bad double")


#: Fewest arrivals that are fitted; least background rate, greatest branching ratio and range of decay, all per day.
MIN_EVENTS, MIN_MU, MAX_ALPHA, BETA = 20, 1e-8, 0.95, (1e-3, 1e5)


def hour_integral(t: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Integral from 0 to t (days from a day boundary) of an hourly shape of mean 1."""
    whole = np.floor(t)
    at = (t - whole) * 24
    hour = np.minimum(at.astype(int), 23)
    return whole + np.concatenate([[0.0], np.cumsum(shape) / 24])[hour] + shape[hour] * (at - hour) / 24


def hawkes_fit(t: np.ndarray, horizon: float, shape: np.ndarray) -> tuple[float, float, float]:
    """(mu, alpha, beta) of most likelihood for rate mu s(t) + alpha beta sum exp(-beta (t - t_i)); t sorted, in days.

    For a given beta the likelihood is concave in the other two, which expectation
    maximisation climbs; beta is searched over a grid of its range, cut finer around the best.
    """
    s, gaps, span = shape[np.minimum((t % 1 * 24).astype(int), 23)], np.diff(t), float(hour_integral(np.array([horizon]), shape)[0])
    low, high, best = *np.log(BETA), None
    for points in (41, 9, 9, 9):
        beta = np.exp(np.linspace(low, high, points))
        kernel = np.zeros((len(t), points))
        for k, gap in enumerate(gaps):
            kernel[k + 1] = np.exp(-beta * gap) * (1 + kernel[k])
        kernel *= beta
        spent = -np.expm1(-beta * (horizon - t)[:, None]).sum(axis=0)
        mu, alpha = np.full(points, max(0.8 * len(t) / span, MIN_MU)), np.full(points, 0.2)
        for _ in range(500):
            share = 1 / (mu * s[:, None] + alpha * kernel)
            new_mu, new_alpha = np.maximum(mu * (s[:, None] * share).sum(axis=0) / span, MIN_MU), np.minimum(alpha * (kernel * share).sum(axis=0) / np.maximum(spent, 1e-300), MAX_ALPHA)
            still = np.abs(new_mu - mu).max() < 1e-7 * mu.max() and np.abs(new_alpha - alpha).max() < 1e-7
            mu, alpha = new_mu, new_alpha
            if still:
                break
        value = np.log(mu * s[:, None] + alpha * kernel).sum(axis=0) - mu * span - alpha * spent
        i = int(value.argmax())
        if best is None or value[i] > best[0]:
            best = float(value[i]), float(mu[i]), float(alpha[i]), float(beta[i])
        step = (high - low) / (points - 1)
        low, high = max(np.log(BETA[0]), np.log(best[3]) - step), min(np.log(BETA[1]), np.log(best[3]) + step)
    return best[1:]


def hawkes_increments(t: np.ndarray, mu: float, alpha: float, beta: float, shape: np.ndarray) -> np.ndarray:
    """Integral of the fitted rate between consecutive arrivals; history before the first is left out."""
    out, q = mu * np.diff(hour_integral(t, shape)), 1.0
    for k, gap in enumerate(np.diff(t)):
        decay = np.exp(-beta * gap)
        out[k] += alpha * (1 - decay) * q
        q = decay * q + 1
    return np.maximum(out, 0.0)


def hawkes_residual_ks(arrivals: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n, d): KS distance from uniform of 1 - exp(-increment) of a fitted Hawkes compensator over a key's sorted arrivals.

    Arrivals are in seconds since the epoch. The window is of whole UTC days, from that of a key's
    first arrival through that of its last; the hourly shape is the share of arrivals by hour,
    one added to each. n is the number of gaps; d is null for keys of fewer than MIN_EVENTS arrivals.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[at].dropna().to_numpy(float)) / 86_400
        n = max(0, len(t) - 1)
        if len(t) < MIN_EVENTS:
            return pd.DataFrame({key: pdf[key].iloc[:1], "n": [n], "d": [np.nan]})
        t = t - np.floor(t[0])
        hours = np.bincount(np.minimum((t % 1 * 24).astype(int), 23), minlength=24) + 1.0
        shape = hours / hours.mean()
        u = np.sort(-np.expm1(-hawkes_increments(t, *hawkes_fit(t, float(np.floor(t[-1]) + 1), shape), shape)))
        i = np.arange(1, n + 1)
        return pd.DataFrame({key: pdf[key].iloc[:1], "n": [n], "d": [float(max((i / n - u).max(), (u - (i - 1) / n).max()))]})

    return arrivals.select(key, at).groupBy(key).applyInPandas(run, f"{key} {dict(arrivals.dtypes)[key]}, n int, d double")
