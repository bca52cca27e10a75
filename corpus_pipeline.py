"""The corpus pipeline: documents in, training tokens out.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidloom.llm import minhash, mixing, pieces, toxicity
from bidloom.llm.common import table, written


#: The threshold of the near-duplicate stage and its bands: pairs of that similarity share none with a probability of about 4e-6.
NEAR = {"percent": 80, "bands": 41, "rows": 6}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection score; the lexicon is learned from the labelled ones among them.

    Null and empty texts have the lowest score and stay; rows of one id and text are judged alike; an empty table stays empty."""
    return toxicity.clean_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Texts without words are like nothing and stay; equal rows are one group, with or without ids; an empty table stays empty."""
    return minhash.without_near_duplicates(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them.

    Null sources are a source of their own; texts without words weigh nothing, and may stand once more than others; equal
    rows are taken one by one; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document of the mix, a row for each time it is taken; null texts are encoded as empty ones."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Learned lexicons and Viterbi paths can't be expressed in SQL; tests/llm/test_pipeline.py compares each stage with a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the table that the one before wrote. The last one's rows aren't written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
