"""A corpus pipeline: quality rules, exact copies, near copies, personal data, packing.

Results for special rows, stage by stage: a null or empty text has no words and is rejected
by the quality rules; were it kept, it would be an exact copy of every other empty text, alone
among near copies, without personal data, and one end id in the packing.  Rows that are equal
in all columns are exact copies; a null doc_id is the smallest.  An empty table passes through
every stage.  Columns beyond those of documents are kept as they are by all stages but the
last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import exact_dedup, ngram_join, packing, pii_votes, quality_lists
from veilframe.llm.common import settled, shared_path, spread_free

#: The end of a document in a sequence.
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned list or the base rule rejects go."""
    rules = quality_lists.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality_lists.judged(docs, rules).where("kept")
    return kept.select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the least doc_id stays."""
    return ngram_join.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts become the name of their kind.  The texts are
    searched once: what is found is kept beside them."""
    own = spread_free("found", docs.columns)
    rows = settled(pii_votes.found(docs, "text", own), "spans")
    return pii_votes.redact_found(rows, pii_votes.fit(rows, own), own).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The learned rules, the span classifier and the tokenizer have no SQL form; a test holds
#: the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
