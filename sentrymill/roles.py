"""Column roles: operators see an event table through these names, whatever its columns are called.

entity, counterparty, time, amount, failed, refund, category, device, plus event_id for a total order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = "2024-01-01"


@dataclass(frozen=True)
class Roles:
    event_id: Column
    entity: Column
    counterparty: Column
    time: Column
    amount: Column
    failed: Column
    refund: Column
    category: Column
    foreign: Column
    absent: Column
    device: Column
    origin: str = ORIGIN


def events_roles() -> Roles:
    """The driver's stream table; flags are stand-ins by event type."""
    kind = F.col("event_type")
    return Roles(
        event_id=F.col("event_id"),
        entity=F.col("user_id"),
        counterparty=F.get_json_object("props", "$.k"),
        time=F.col("ts").cast("timestamp"),
        amount=F.col("value"),
        failed=kind == "error",
        refund=kind == "signup",
        category=kind,
        foreign=kind == "view",
        absent=kind == "click",
        device=F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 11),
    )


def bound(df: DataFrame, roles: Roles) -> DataFrame:
    """df under role names, with the day as a number since the origin; other columns are left out."""
    out = df.select(*[getattr(roles, name).alias(name) for name in ("event_id", "entity", "counterparty", "time", "amount", "failed", "refund", "category", "foreign", "absent", "device")])
    return out.withColumn("day", F.datediff(F.to_date("time"), F.lit(roles.origin).cast("date")))
