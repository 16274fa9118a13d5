"""A corpus from raw documents: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's rows as
Parquet in the shared folder and reads them again for the next one.  All stages but the last return
the columns of documents.  A stage that begins removes the tables which earlier stages have written
along the way, so a stage's result is to be written before the next stage begins.

Rows are told apart by numbers of their own: null and repeated ids, repeated rows and ties never make a
stage drop a document that it would keep alone.  Null and empty texts pass all stages but the first,
whose model decides on them like on others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import decontamination, near_duplicates, pieces, private_data, quality, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones does not draw go."""
    with store.step(docs):
        return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) one document stays."""
    with store.step(docs):
        return near_duplicates.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    with store.step(docs):
        return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; ``n_chars`` is counted anew."""
    with store.step(docs):
        clean = private_data.redact(docs)
        return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text."""
    with store.step(docs):
        out = pieces.with_samples(docs.select("doc_id", "text"))
        return out.select("doc_id", "samples")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_first),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained model and sampling can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
