"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before
it kept; all but the last return the columns of documents. ``run`` writes each stage's
rows as Parquet in the folder that the cluster shares and rereads them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from modalflow.llm import bpe, decontam, linededup, minhash, registry, toxicity
from modalflow.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier scores at 0.5 or more go."""
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: near copies of earlier lines go from the texts, as do documents left empty by that."""
    return linededup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near duplicates stays."""
    return minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold benchmark passages go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token counts and digests of the ids and of the decoded bytes."""
    return bpe.digest(docs, public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The classifier and the tokenizer have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
