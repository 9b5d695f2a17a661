"""What the operators share: reading tables, words, checkpoints, Arrow row mapping."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other than ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(texts: DataFrame, column: str) -> int:
    """Bytes of all texts in a column."""
    return int(texts.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder, its lineage cut.

    What was shuffled on the way goes once it is written; else it stays on the executors' disks until the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    context, cleanup = spark.sparkContext, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for what is planned from here on
    finally:
        spark.conf.set(cleanup, before)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="sentrymill-")


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; text as UTF-8 bytes, null text as empty bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [x or b"" for x in column.to_pylist()]
    return column.to_pylist()


def rows_one_by_one(batch: pa.RecordBatch):
    """The rows of a batch in turn, so that one large value at a time is copied."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def per_row(df: DataFrame, function, schema: str) -> DataFrame:
    """function(batches of columns as dicts of lists) -> dict of lists or arrays, by Arrow batches.

    Memory is bounded by Spark's Arrow batch limits (rows and bytes).
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function({n: rows_of(batch, n) for n in batch.schema.names})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder (a temporary folder where none is set)."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
