"""The queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from ._spark import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """How the byte-level vocabulary splits text."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def pack_documents(docs: DataFrame) -> DataFrame:
    """docs in sequences of the byte-level vocabulary."""
    from .packing import pack

    return pack(docs, vocabulary("byte_bpe_50k.json"), pattern())


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import cluster

    return cluster(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digest

    return digest(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import hits

    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language, op3_quality_rules, op4_jaccard_join, op5_substring_dedup, op6_html_extraction, op7_decontamination, op8_packing, op9_lm_scoring, op10_quality_classifier, pipeline)}
#: Operators that DuckDB can express over whole tables.
ORACLE: dict[str, str] = {"op4_jaccard_join": oracles.JACCARD, "op5_substring_dedup": oracles.SUBSTRING, "op7_decontamination": oracles.DECONTAMINATION}
