"""A corpus pipeline of five stages, each of them one of the operators of candela.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of `documents`, the last
the packed sequences. Between stages, the driver writes and rereads Parquet; `run` cuts the lineage instead.

Cases, in every stage: null text counts as empty, is never toxic by itself, is a near-duplicate of empty texts only, and
gives the end id alone; null ids, sources, languages and lengths are kept as they are; repeated rows and ids are each
judged, and near-duplicates leave one of them; texts are read whole, whatever their length; an empty table gives an empty
result; extra columns keep their names and values up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm import bagminhash, common, mixing, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5, so that doubtful ones stay."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return bagminhash.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind; n_chars follows."""
    return pii.redact(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt to files and sorted within them in the order of the schedule."""
    return mixing.in_schedule_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence, with its ids; equal lengths lie together, in the order of the schedule."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The decoder, the signatures and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.checkpointed(docs)
    return docs
