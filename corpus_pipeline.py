"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result and reads it again as
the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, written
from marlstone.llm.decontaminate import remove_contaminated
from marlstone.llm.line_chunks import remove_repeats
from marlstone.llm.near_copies import keep_one
from marlstone.llm.packing import pack_documents
from marlstone.llm.toxicity import toxicity

#: Rows that go to a Python worker at once; texts are long, and what a batch takes stays with the executor.
BATCH = 2000


def in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, takes for toxic go.

    Null and empty texts are judged as empty ones; equal texts share their fate; without labels every document stays.
    """
    scored = toxicity(docs, docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where("p_toxic <= 0.5").select(*docs.columns)


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that occurred before go; every document stays, with its n_chars counted again.

    Null and empty texts stay so, with the length that goes with them; equal rows share their fate.
    """
    kept = remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@in_small_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: five-word shingles, similarity of 0.8 or more.

    It is the one of the smallest doc_id, and one row of equal ones. Texts without words are one group; rows without a
    doc_id stay.
    """
    return keep_one(docs)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item, or a whole shorter item, go.

    Null and empty texts stay; every row is judged on its own.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 1024 ids; a null or empty text is its end id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Tokenizer ids, learned models and fingerprints are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
