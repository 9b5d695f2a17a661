"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, fresh


#: Repeated hashes up to this many (16 bytes each) are broadcast to the scan of texts; more are joined by shuffle.
BROADCAST_HASHES = 1_000_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=ascii_lower) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts group by the MD5 of their normalised bytes, and by SHA-256 within that, over narrow rows
    written to the checkpoint folder. Bytes are compared where hashes repeat: those texts group
    by hash and the bytes themselves, and copies meet in the map-side partial aggregate, so a
    group of any size ships one text per task. Texts whose MD5 alone is equal form groups of
    their own; should two texts share both hashes, the query raises an error.

    keep: "min" or "max", the id that stays. Null text counts as empty. Rows with equal id and
    text are one another's copies and are all kept when that id stays; a null id stays only in
    a group where all ids are null. Extra columns are ignored; an empty table gives no rows.
    """
    best = {"min": F.min, "max": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).withColumn("h", F.unhex(F.md5("t")))
    rows = checkpointed(texts.select("id", "h", F.unhex(F.sha2("t", 256)).alias("s")))
    groups = checkpointed(rows.groupBy("h", "s").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id")))
    repeated = groups.groupBy("h").agg(F.sum("group_size").alias("n")).filter("n > 1").select("h")
    again = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    bytes_met = texts.select("h", "t").join(again, "h", "left_semi").groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"))
    met = bytes_met.select("h", F.unhex(F.sha2("t", 256)).alias("s")).groupBy("h", "s").agg(F.count(F.lit(1)).alias("texts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256"))).otherwise(F.col("group_size"))
    # written, so that both sides of the last join come from shuffles that Spark may split where a group is hot
    compared = checkpointed(groups.join(met, ["h", "s"], "left").withColumn("group_size", sure).drop("texts"))
    return rows.join(compared, ["h", "s"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=ascii_lower) -> DataFrame:
    """docs with one row of each text left, that of the id exact_dedup keeps; all columns as they were.

    One aggregate by hash and bytes, with the whole row as its value: copies meet before the
    shuffle, and rows that repeat an id as well leave the one greatest (least) in its other
    columns, which must be orderable. Null text counts as empty. Extra columns may have any
    names; an empty table gives no rows.
    """
    key, value, digest = fresh(docs, "copy_text", "copy_row", "copy_hash")
    rest = [F.col(c) for c in docs.columns if c != id_col]
    known = F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull()
    row = F.struct(known.alias(digest), F.col(id_col), *rest)
    keyed = docs.select(normalise(F.coalesce(F.col(text_col), F.lit(""))).alias(key), row.alias(value)).withColumn(digest, F.unhex(F.md5(key)))
    best = {"min": F.min, "max": F.max}[keep]
    return keyed.groupBy(digest, key).agg(best(value).alias(value)).select(*[F.col(value)[c].alias(c) for c in docs.columns])
