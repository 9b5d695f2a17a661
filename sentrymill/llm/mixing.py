"""Mixing sources to target weights by pivotal dependent rounding.

Each document's expected copies are its source's target over its source's size. The whole
part is sure; the fractional parts are rounded dependently: two documents of a source trade
words, in a direction drawn so that each keeps its expectation, until one of them is whole.
Words are conserved by each trade, so a source's total differs from its target by less than
the size of the one document left over at the top of the reduction tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh

ROUND_SCHEMA = "id bigint, source_no int, bucket bigint, size bigint, sure int, share double"


def source_targets(sized: DataFrame, weights: tuple = (3.0, 1.0, 2.0), total_ratio: float = 1.5, max_ratio: float = 2.0) -> DataFrame:
    """One row per source: source, source_no, source_size, n, target; sized has source, size and rows (how many documents are so).

    Sources by code point, null last, take weights in turn. Targets share total_ratio of all
    sizes by weight, none above max_ratio of its source: the water level over the sources'
    caps, found from running sums in order of cap over weight. The windows see one row per
    source.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("source_no", F.row_number().over(order).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_ratio))).withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(total_ratio)))
    rising = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(fits, F.lit(float("inf"))) * F.col("weight"))
    return per.withColumn("target", target).select("source", "source_no", "source_size", "n", "target")


def round_group(source_no: int, size: np.ndarray, share: np.ndarray, random: np.random.Generator, last: bool) -> np.ndarray:
    """Shares rounded to 0 or 1 but for one at most; with last, that one too is drawn."""
    share = share.copy()
    draws = random.random(len(share))
    held = -1
    for k in range(len(share)):
        if not 0.0 < share[k] < 1.0:
            continue
        if held < 0:
            held = k
            continue
        p, w, q, v = share[held], size[held], share[k], size[k]
        up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
        if draws[k] * (up + down) < down:
            whole = (1 - p) * w <= q * v
            p, q = (1.0, max(0.0, q - up / v)) if whole else (min(1.0, p + up / w), 0.0)
        else:
            whole = p * w <= (1 - q) * v
            p, q = (0.0, min(1.0, q + down / v)) if whole else (max(0.0, p - down / w), 1.0)
        share[held], share[k] = p, q
        held = held if 0.0 < p < 1.0 else k if 0.0 < q < 1.0 else -1
    if last and held >= 0:
        share[held] = 1.0 if random.random() < share[held] else 0.0
    return share


def _rounder(seed: int, level: int, last: bool):
    def rounded(table: pa.Table) -> pa.Table:
        of = {c: table.column(c) for c in table.column_names}
        ids, size, share = of["id"].fill_null(-1).to_numpy(), of["size"].to_numpy(), of["share"].to_numpy()
        if "rows" in of:
            table = table.drop_columns("rows").take(pa.array(np.repeat(np.arange(len(ids)), of["rows"].to_numpy())))
            ids, size, share = (np.repeat(x, of["rows"].to_numpy()) for x in (ids, size, share))
        order = np.lexsort((share, size, ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
        at = [seed, level, *(int(of[c][0].as_py()) for c in ("source_no", "bucket"))]
        new = round_group(at[2], size[order].astype(float), share[order], np.random.default_rng(at), last)
        return table.take(pa.array(order)).set_column(table.column_names.index("share"), "share", pa.array(new))

    return rounded


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (3.0, 1.0, 2.0),
    total_ratio: float = 1.5,
    max_ratio: float = 2.0,
    seed: int = 17,
    bucket_rows: int = 5_000,
    fan_in: int = 1_000,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    size: the text's words (null: 0). Documents are dealt by a hash of their id to buckets of
    about bucket_rows within their source, rounded there, and each bucket's leftover goes up a
    tree of fan_in; each step's rows are written to the checkpoint folder. Documents of equal
    id, source and size are counted first and dealt in runs of bucket_rows, so that an id that
    a third of all rows share fills many buckets. Results depend on ids, sizes, sources and the
    seed, never on how rows are laid out. Documents without words take none of the mix and get
    the whole part of their copies. Repeated rows are documents of their own; a null id is one
    more id. Extra columns are ignored; an empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = checkpointed(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    targets = checkpointed(source_targets(sized, weights, total_ratio, max_ratio))
    per = targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per = per.withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_rows)))
    most = per.agg(F.max("buckets")).first()[0]
    rows = sized.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / bucket_rows).cast("long"))))
    rows = rows.withColumn("rows", F.least(F.lit(bucket_rows), F.col("rows") - F.col("run") * bucket_rows))
    rows = rows.select(
        "id", "source_no", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)) + F.col("run"), F.col("buckets")).alias("bucket"), "size", "rows",
        F.floor("ratio").cast("int").alias("sure"), F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("share"),
    )
    done, level = [], 0
    while True:
        last = (most or 1) <= 1
        rows = checkpointed(rows.groupBy("source_no", "bucket").applyInArrow(_rounder(seed, level, last), ROUND_SCHEMA))
        whole = F.col("share").isin(0.0, 1.0)
        done.append(rows.filter(whole))
        if last:
            break
        rows, most, level = rows.filter(~whole).withColumn("bucket", F.floor(F.col("bucket") / fan_in)), -(-most // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("sure") + F.col("share").cast("int")
    return out.join(targets.withColumnRenamed("source", "src"), "source_no").select(
        F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them: none, one or more rows of each, all columns as they were.

    Rows that repeat an id each take the most copies drawn for it; rows of a null id do so too.
    Null and empty texts have no words and get the whole part of their source's ratio of target
    to size. Extra columns may have any names; an empty table gives no rows.
    """
    key, copies, n = fresh(docs, "mix_id", "mix_copies", "mix_n")
    taken = mix(docs, id_col, **options).filter("copies > 0").groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(copies))
    joined = docs.join(taken, F.col(id_col).eqNullSafe(F.col(key)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])
