"""Writers: contract tables, panels by split, resumable chunks, canonical JSON, content hashes."""

from __future__ import annotations

import hashlib
import json
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, max_records: int | None = None, mode: str = "error") -> None:
    """Zstandard Parquet by Spark's commit protocol; files hold max_records rows at most."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_missing(df: DataFrame, path: str, key: str, done: DataFrame | None) -> None:
    """Append only the keys that an earlier run didn't finish."""
    write_table(df if done is None else df.join(done.select(key).distinct(), key, "left_anti"), path, mode="append")


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and an order-insensitive hash over all columns, by name."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("content_hash"))


def canonical_json(document) -> tuple[bytes, int]:
    """Sorted keys, LF, not-a-number and infinities as null; and how many of those there were."""
    census = 0

    def clean(x):
        nonlocal census
        if isinstance(x, float) and not math.isfinite(x):
            census += 1
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return (json.dumps(clean(document), sort_keys=True, indent=1, ensure_ascii=False, allow_nan=False) + "\n").encode(), census


def write_artifact(folder: str, name: str, document) -> tuple[str, int]:
    """The document in canonical bytes under folder; returns their SHA-256 and how many values had to become null."""
    data, census = canonical_json(document)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.json"), "wb") as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest(), census


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report table; one of more than limit rows is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows in a report")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
