"""Point-in-time readers. Labels are read through available_labels alone."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_utc(as_of: dt.datetime) -> dt.datetime:
    """as_of if it carries UTC; naive and other-zone instants are refused."""
    if as_of.tzinfo is None or as_of.utcoffset() != dt.timedelta(0):
        raise ValueError("as_of must be timezone-aware UTC")
    return as_of


def instant(as_of: dt.datetime) -> Column:
    return F.lit(require_utc(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def contract(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df forced to a contract: its columns, in its order, cast; missing columns raise."""
    missing = [c for c in schema if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def events_as_of(df: DataFrame, time_col: str, as_of: dt.datetime, entity_col: str | None = None, entity=None, since: dt.datetime | None = None) -> DataFrame:
    """Rows at or before as_of (and at or after since), of one entity if given. Filters reach the scan."""
    out = df.filter(F.col(time_col).cast("timestamp") <= instant(as_of))
    if since is not None:
        out = out.filter(F.col(time_col).cast("timestamp") >= instant(since))
    return out.filter(F.col(entity_col) == entity) if entity_col and entity is not None else out


def masked_as_of(df: DataFrame, visible_col: str, settled_col: str, as_of: dt.datetime) -> DataFrame:
    """Rows visible at as_of, with what settles later set to null."""
    seen = events_as_of(df, visible_col, as_of)
    return seen.withColumn(settled_col, F.when(F.col(settled_col).cast("timestamp") <= instant(as_of), F.col(settled_col)))


def available_labels(labels: DataFrame, as_of: dt.datetime, include_censored: bool = False) -> DataFrame:
    """The only door to labels: those available at as_of, censored ones on request."""
    out = labels.filter(F.col("label_available_at").isNotNull() & (F.col("label_available_at").cast("timestamp") <= instant(as_of)))
    return out if include_censored else out.filter(~F.col("is_censored"))


def label_coverage(labels: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row: total, available, censored, pending, positive, and ratios."""
    open_ = F.col("label_available_at").isNotNull() & (F.col("label_available_at").cast("timestamp") <= instant(as_of)) & ~F.col("is_censored")
    out = labels.agg(F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("available"), F.count_if(F.col("is_censored")).alias("censored"), F.count_if(open_ & (F.col("label") == 1)).alias("positive"))
    return out.withColumn("pending", F.col("total") - F.col("censored") - F.col("available")).withColumns(
        {"prevalence": F.when(F.col("available") > 0, F.col("positive") / F.col("available")), "coverage": F.when(F.col("total") > 0, F.col("available") / F.col("total"))}
    )


def bounds(df: DataFrame, day_col: str) -> DataFrame:
    """First and last day; an empty table raises when the row is read."""
    out = df.agg(F.min(day_col).alias("first_day"), F.max(day_col).alias("last_day"))
    return out.withColumn("first_day", F.when(F.col("first_day").isNull(), F.raise_error(F.lit("no events"))).otherwise(F.col("first_day")))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines or CSV by extension, columns projected at the scan; a CSV in a zip goes through the driver's memory."""
    if path.endswith(".zip"):
        rows = spark.sparkContext.binaryFiles(path).values().first()
        with zipfile.ZipFile(io.BytesIO(rows)) as z:
            name = next(n for n in z.namelist() if n.endswith(".csv"))
            lines = list(csv.reader(io.TextIOWrapper(z.open(name), "utf-8")))
        df = spark.createDataFrame(lines[1:], schema=lines[0])
    elif path.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    elif path.endswith((".json", ".jsonl")):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    elif path.endswith(".orc"):
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON documents, one row each, with the file's name."""
    return spark.read.option("multiLine", True).json(f"{folder}/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
