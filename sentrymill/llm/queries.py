"""The operators over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import bpe_digest
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify
from .licences import inherited, scan
from .lm_score import lm_score
from .mixing import mix
from .pii import KINDS, pii_spans
from .quality import quality_rules
from .simhash import near_duplicates
from .substring_dedup import kept_digest, remove_passages


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_licence_scan(spark, sf_dir):
    """documents have no paths; each is put at its source, in a folder of 64 ids within one of 4096."""
    docs = table(spark, sf_dir, "documents")
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return inherited(scan(docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), folder(4096), folder(64), F.col("doc_id").cast("string")))))


def op3_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op4_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark, sf_dir):
    """Counts are of the base spans; spans has them and what deobfuscation adds."""
    found = pii_spans(table(spark, sf_dir, "documents"))
    listed = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.array_compact(F.transform("base", lambda x: F.when(x["kind"] == F.lit(k), 1)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_lm_score(spark, sf_dir):
    return lm_score(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return kept_digest(remove_passages(table(spark, sf_dir, "documents"), window=35))


def op8_bpe(spark, sf_dir):
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_exact_dedup, op2_licence_scan, op3_mix_sources, op4_simhash, op5_pii, op6_lm_score, op7_substring_dedup, op8_bpe, op9_quality_rules, op10_language_id)}


def oracle_sql():
    return {"op1_exact_dedup": OP1}


OP1 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
