"""Event streams in Structured Streaming: daily windows with a watermark, and keyed baselines.

Late rule: events older than the watermark are dropped; the batch form has no such rule, so
parity holds for streams whose lateness stays within it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructType


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(entity, start, n, gmv) by tumbling day; stream under role names."""
    kept = ~F.col("failed") & ~F.col("refund")
    per = stream.withWatermark("time", lateness).groupBy(F.window("time", "1 day").alias("w"), "entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(kept, F.col("amount")).otherwise(0.0)).alias("gmv"))
    return per.select("entity", F.col("w.start").alias("start"), "n", "gmv")


STATE = "last_day int, n long, total long, days int"


def running_baseline(keys, batches, state: GroupState):
    """Per entity: closed days folded into count sums; emits (entity, day, n, mean) for each day as it closes.

    Rows of a micro-batch come unordered and are sorted by time here; state is four numbers a key. The last
    day stays open until a later one comes; rows of a day already closed are left out.
    """
    last, n, total, days = state.get if state.exists else (-1, 0, 0, 0)
    out = []
    rows = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
    for day in sorted(rows["day"].tolist()):
        if last >= 0 and day > last:
            days, total = days + 1, total + n
            out.append((keys[0], last, n, total / days))
            n = 0
        if day >= last:
            last, n = day, n + 1
    state.update((last, n, total, days))
    yield pd.DataFrame(out, columns=["entity", "day", "n", "mean"])


def closed_days(stream: DataFrame) -> DataFrame:
    return stream.groupBy("entity").applyInPandasWithState(running_baseline, "entity long, day int, n long, mean double", STATE, "append", GroupStateTimeout.NoTimeout)


def to_files(out: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Run what is available to the end; the rows it made, as Parquet under folder, which all machines share.

    Each micro-batch overwrites its own part, so a batch that is run again adds nothing. With keys
    (mode update), the last batch's row of a key counts. The folder holds the query's checkpoint
    too: a later call with the same folder goes on where this one ended.
    """
    spark, rows = out.sparkSession, f"{folder}/rows"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    query = out.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return _read(spark, rows, out, keys) if _exists(spark, rows) else spark.createDataFrame([], out.schema)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark, rows: str, out: DataFrame, keys: list[str] | None) -> DataFrame:
    every = spark.read.schema(StructType([*out.schema.fields]).add("batch", LongType())).parquet(rows)
    if not keys:
        return every.drop("batch")
    rest = [c for c in out.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in out.columns])
