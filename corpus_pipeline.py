"""A corpus from raw documents to token ids: five stages, each an operator of sentrymill.llm.

Each stage takes what its predecessor kept and is written as Parquet before the next reads it.
The final rows hold doc_id, n_tokens and ids (token ids of the whole text); a document
that the mix takes twice has two rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm.bpe import bpe_encode
from sentrymill.llm.common import remove, scratch, table
from sentrymill.llm.exact_dedup import drop_copies
from sentrymill.llm.langid import keep_identified
from sentrymill.llm.mixing import mixed
from sentrymill.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and longer ones far from every language.

    Null and empty texts go; repeated rows stay or go together; extra columns are kept, whatever
    their names; an empty table stays empty, as does one without labels stay whole.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the smallest doc_id stays.

    Null counts as empty; of rows that repeat an id and text one stays; a null id goes before any
    other of its text; extra columns are kept; an empty table stays empty.
    """
    return drop_copies(docs, keep="min")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays; links are of a Jaccard similarity of five-word
    shingles of 0.8 or more, candidates by four fingerprint tables and min-hash bands.

    Null and empty texts are equal; rows that repeat the id that stays all stay; a null id goes if
    another is near; extra columns are kept; an empty table stays empty.
    """
    return drop_near_duplicates(docs, shingle=5, bits=3, tables=4, jaccard=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat or go.

    Null and empty texts have no words and stay by the whole part of their source's ratio; rows
    that repeat an id get equal copies; a null source is one more, the last; extra columns are
    kept; an empty table stays empty.
    """
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each whole text; null and empty texts have none.

    Rows map one to one; extra columns go; an empty table stays empty.
    """
    ids = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: The mix is drawn at random and BPE has no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared scratch folder and read again.

    A stage's folder goes once the next one is written; the last one's stays for its reader.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
