"""The corpus pipeline over ``documents``: quality filter, near-duplicates,
decontamination, mixing, token files.

Every stage works on all rows that its predecessor kept, takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result and reads it again. Rows with nulls
in any column, repeated rows and empty tables pass through the operators as
their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventspark.llm import arrow_output, lsa_vote, mixing, odd_sketch, wu_manber
from eventspark.llm.common import Workspace, read_table
from eventspark.llm.entry import tokenizer_path


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return lsa_vote.keep(spark, docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return odd_sketch.keep_one(spark, docs, shingle_words=5, threshold=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth is benchmark text go."""
    return wu_manber.clean(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to meet the sources' weights."""
    return mixing.mix(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document of the mix, from them."""
    return arrow_output.digest(spark, docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: SQL can't express the classifier and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
