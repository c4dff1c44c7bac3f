"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever they
are beside doc_id, text, source and n_chars. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import alike, mixing, packing, pii, quality
from keyloom.llm.common import stage, table
from keyloom.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep, repeated rows as often as they come. Null and
    empty texts have no word and go; a null doc_id is like any other, but no label is its own."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: wide SimHashes propose pairs, a Jaccard similarity of five-word
    shingles of 0.8 or more decides. The smallest doc_id of a group stays (null last, ties by a hash of the text), once; all
    texts without a word are one group."""
    return alike.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data, secrets and disclosing terms replaced in its text, and n_chars counted anew; a null
    text stays null."""
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return pii.find_personal_data(docs).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for. A null source is one, the last; documents without
    a word have size 0 and are taken as often as whole epochs of their source are."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, with their ids. A null or empty text has its end id alone."""
    return packing.pack(docs, byte_bpe(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned rules, components of near-duplicates and a tokenizer's ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
