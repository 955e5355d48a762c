"""documents -> packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them to the documents table, writing each
stage's rows as Parquet and reading them again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import langid, mixing, packing, secret_scan, simhash
from weftline.plans.settle import checkpoint_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognised language go, and with them null, empty and letterless
    texts. Null ids, tags and sources stay; repeated rows stay or go together; texts
    count whole; an empty table stays empty; columns of any name are kept."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id, and one of
    rows that repeat id and text. Null ids and texts without a word all stay; texts
    count whole; an empty table stays empty; columns of any name are kept."""
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask; no document goes. Null and empty
    texts stay as they are; texts are scanned whole; repeated rows are changed alike;
    an empty table stays empty; columns of any name are kept."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned to their source's weight. A null source is a
    source, a null id draws as an empty one, null and empty texts take their source's
    rate; repeated rows are drawn alike; an empty table stays empty; columns of any name
    are kept."""
    return mixing.mix(docs, detail=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document gets its place in a training sequence. Texts without
    a token have nothing to pack; longer ones than a sequence are cut into pieces;
    copies and null ids are told apart by number; an empty table gives an empty
    result."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A genetic algorithm and a trained forest aren't SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for ``documents``. What a stage wrote goes once the next one
    has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
