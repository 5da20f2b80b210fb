"""A corpus pipeline out of the training-data operators: each stage takes and returns documents.

The stages' decisions are those of the operators' own queries: a document is kept by its
whole text, all columns and rows as they came. The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinity.llm import decontamination, packing, quality, simhash, toxicity
from affinity.llm.common import cut, held_out
from affinity.llm.queries import table, vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject, fitted on the labelled ones among them."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep_good(docs, quality.fit(docs, marks))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages; labels are learnt from the query's training rows."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_civil(docs, toxicity.fit(docs, marks, ~held_out("doc_id", 4)), threshold=0.3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return simhash.keep_one(docs, bits=2, shingle=3)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or paraphrased."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", good), ("toxicity", civil), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("packing", packed)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written down before the next reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
