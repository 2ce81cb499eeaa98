"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1.  quality classifier: documents it rejects go.
2.  n-gram Jaccard join: of each group of near duplicates the document with the smallest doc_id stays.
3.  substring dedup: words in 35-word passages that repeat are removed; documents that lose every word go.
4.  benchmark decontamination: contaminated documents go.
5.  packing: what is left is laid out in sequences of 1024 tokens.

All but the last stage return the columns of documents (n_chars is the length of the text as it is then).

Defined results of every stage: a null or empty text is not rejected, links with nothing, loses nothing, is clean, and is
packed as its end token; documents that share an id, or have none, are told apart by their text, and of equal rows one
stays after the second stage; at a threshold a link, a hit or a rejection holds; very long texts are handled whole;
other columns, whatever their names, pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import classifier, decontaminate, jaccard, substring
from cairnframe.llm._spark import stored, table
from cairnframe.llm.queries import pack_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.remove(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", passages),
    ("decontamination", contamination),
    ("packing", sequences),
]

#: Classifier, suffix automaton and tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between two of them the documents are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
