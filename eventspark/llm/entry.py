"""One registered query per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventspark.llm import (arrow_output, diagonal_runs, laesa, lexicon_toxicity, lsa_vote, mixing, nn_descent, odd_sketch, risk_rules, script_viterbi,
                            secret_ledger, suffix_dedup, wu_manber)
from eventspark.llm.common import read_table


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(spark, read_table(spark, sf_dir, "documents"), shingle_words=3, threshold=(85, 100))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(spark, read_table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """Where this machine keeps the public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.digest(spark, read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(spark, read_table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(spark, read_table(spark, sf_dir, "documents"))


def op7_lsa_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_vote.score(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_viterbi.identify(spark, read_table(spark, sf_dir, "documents"))


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_toxicity.score(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.digest(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonal_runs.digest(spark, read_table(spark, sf_dir, "documents"))


def op12_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.digest(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.digest(spark, read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_odd_sketch": op1_minhash_odd_sketch,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_nn_descent": op3_nn_descent,
        "op4_arrow_token_files": op4_arrow_token_files,
        "op5_source_mixing": op5_source_mixing,
        "op6_secret_ledger": op6_secret_ledger,
        "op7_lsa_vote": op7_lsa_vote,
        "op8_script_viterbi": op8_script_viterbi,
        "op9_lexicon_toxicity": op9_lexicon_toxicity,
        "op10_wu_manber": op10_wu_manber,
        "op11_diagonal_runs": op11_diagonal_runs,
        "op12_risk_rules": op12_risk_rules,
        "op13_laesa_clusters": op13_laesa_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mixing": mixing.SQL,
        "op6_secret_ledger": secret_ledger.SQL,
        "op10_wu_manber": wu_manber.SQL,
        "op11_diagonal_runs": diagonal_runs.SQL,
        "op12_risk_rules": risk_rules.SQL,
        "op13_laesa_clusters": laesa.SQL,
    }
