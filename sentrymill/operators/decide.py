"""From scores to actions under a daily capacity, and the cost arithmetic around it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import best


@dataclass(frozen=True)
class Costs:
    review: float = 250.0
    recovered: float = 0.8
    false_hold: float = 8000.0
    hold_score: float = 0.90
    hold_exposure: float = 25_000.0
    loss_multiplier: float = 1.0


def expected_costs(p: Column, exposure: Column, costs: Costs = Costs()) -> dict[str, Column]:
    """Expected cost of each action; p is a probability and is taken as one, between 0 and 1."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    loss = p * exposure * costs.loss_multiplier
    return {"PASS": loss, "REVIEW": costs.review + (1 - costs.recovered) * loss, "HOLD": costs.review + (1 - p) * costs.false_hold}


def select_actions(scored: DataFrame, capacity: int, costs: Costs = Costs()) -> DataFrame:
    """scored (id, day, p, exposure) with action: the day's best benefits get REVIEW, or HOLD where cheaper and sure.

    Capacity is a ceiling: rows without benefit pass. Ties go by id.
    """
    c = expected_costs(F.col("p"), F.col("exposure"), costs)
    rows = scored.withColumn("benefit", c["PASS"] - F.least(c["REVIEW"], c["HOLD"]))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("benefit"), "id"))
    sure = (c["HOLD"] < c["REVIEW"]) & (F.col("p") >= costs.hold_score) & (F.col("p") * F.col("exposure") >= costs.hold_exposure)
    chosen = (F.col("benefit") > 0) & (rank <= capacity)
    return rows.withColumn("__c", chosen).withColumn("action", F.when(~F.col("__c"), "PASS").when(sure, "HOLD").otherwise("REVIEW")).drop("__c")


def realised_cost(action: Column, bad: Column, loss: Column, costs: Costs = Costs()) -> Column:
    held = F.when(bad, costs.review).otherwise(costs.review + costs.false_hold)
    return F.when(action == "PASS", F.when(bad, loss).otherwise(0.0)).when(action == "REVIEW", F.when(bad, costs.review + (1 - costs.recovered) * loss).otherwise(costs.review)).otherwise(held)


def savings(decided: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row: 1 - total cost / total loss of bad rows, null without losses. decided: action, bad, loss."""
    return decided.agg(F.sum(realised_cost(F.col("action"), F.col("bad"), F.col("loss"), costs)).alias("cost"), F.sum(F.when(F.col("bad"), F.col("loss")).otherwise(0.0)).alias("lost")).select(
        F.when(F.col("lost") > 0, 1 - F.col("cost") / F.col("lost")).alias("savings"), "cost", "lost"
    )


def bayes_minimum_risk(p: Column, exposure: Column, costs: Costs = Costs()) -> Column:
    """The action of least expected cost, the first of PASS, REVIEW, HOLD on a tie."""
    c = expected_costs(p, exposure, costs)
    each = F.array(*c.values())
    return F.element_at(F.array(*map(F.lit, c)), F.array_position(each, F.array_min(each)).cast("int"))


def promote(scored: DataFrame, score: str, share: float = 0.10) -> DataFrame:
    """The best share of rows by score, at least one, ties by id.

    The cut is the k-th score, found from counts by score; only the tie at the cut is ranked.
    """
    n = scored.count()
    return best(scored, score, min(n, max(1, round(n * share))), "id")


def reasons(parts: dict[str, Column], top: int = 3) -> Column:
    """Names of the parts largest by size, in order; ties by position."""
    structs = [F.struct((-F.abs(c)).alias("size"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(parts.items())]
    return F.transform(F.slice(F.array_sort(F.array(*structs)), 1, top), lambda s: s["name"])


def conformal_thresholds(calibration: DataFrame, stratum: str, score: str, alpha: float) -> DataFrame:
    """(stratum, threshold): k-th smallest score with k = ceil((n+1)(1-alpha)); null (no bound) if k > n."""
    w = Window.partitionBy(stratum)
    ranked = calibration.withColumn("__r", F.row_number().over(w.orderBy(score))).withColumn("__n", F.count(F.lit(1)).over(w))
    k = F.ceil((F.col("__n") + 1) * (1 - alpha))
    return ranked.withColumn("__k", k).groupBy(stratum).agg(F.max(F.when(F.col("__r") == F.col("__k"), F.col(score))).alias("threshold"))


def knapsack(rows: DataFrame, budget: int) -> DataFrame:
    """(day, best): most value of a day's rows (day, weight, value) within an integer budget, by dynamic programming.

    The table has budget + 1 cells; a day's candidates are bounded by the screen before it.
    """
    import numpy as np
    import pandas as pd

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(budget + 1)
        for w, v in zip(pdf["weight"].astype(int), pdf["value"]):
            if w <= budget:
                table[w:] = np.maximum(table[w:], table[: budget + 1 - w] + v)
        return pd.DataFrame({"day": [pdf["day"].iloc[0]], "best": [float(table[-1])]})

    return rows.groupBy("day").applyInPandas(best, "day int, best double")
