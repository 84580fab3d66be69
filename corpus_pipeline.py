"""A corpus from raw documents to token ids: every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.

What every stage does with odd rows: a null text counts as an empty one; an empty text has the model's score for no words, toxicity 0, fingerprint
zero, no benchmark window and no tokens; long texts are taken whole. Repeated rows are scored alike, and one of them stays among near duplicates; a
null id is kept and counts as any row. An empty table stays empty. Further columns pass through all stages but the last, whatever their
names, but for the stage's own (_quality, _toxic, _hits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.core.session import remove, scratch, table
from strataweave.llm import bpe, decontam, mil_toxicity, ordinal_quality, simhash

KEEP_TAIL = 0.5
TOXIC = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is above the lowest with probability KEEP_TAIL or more."""
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.score(docs, model).where(F.col("_quality.tail") >= KEEP_TAIL).drop("_quality")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below TOXIC."""
    model = mil_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return mil_toxicity.score(docs, model).where(F.col("_toxic.score") < TOXIC).drop("_toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id; of repeated rows one."""
    return simhash.keep_one_row(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of them and of the decoded bytes."""
    decoded = bpe.encode(docs, decoded=True)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]
#: Learned scores, XXH64 fingerprints and BPE have no SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
