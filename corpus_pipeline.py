"""A training corpus from documents: toxicity, quality rules, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelore.llm import mixing, packing, quality, queries, simhash, toxicity
from pricelore.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled documents, doesn't find toxic.

    Null and empty texts aren't toxic and stay, repeated rows are judged alike, further columns come along; an empty table
    or one without labels loses nothing.
    """
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms are near their language's.

    Null and empty texts fail the base rules and go; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows with a null id stay; null and empty texts are one group; an empty table stays empty.
    """
    return simhash.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the targets of source, language and topic.

    Null categories count as ''; rows that repeat share their lot; an empty table stays empty.
    """
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids.

    A null or empty text has its end id alone; repeated rows are packed each; an empty table has no pieces.
    """
    return packing.pack(docs, queries.byte_ids, end_id=1, size=2048)


STAGES = [("toxicity", toxic), ("quality rules", rules), ("near duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]
#: Trained models and hashes can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep; each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
