"""A corpus from raw documents to packed sequences, stage by stage.

Each stage is given the documents that the one before it kept, as a table read back from storage. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import decontam, langid, line_dedup, ngram_join, packing
from folioworks.tables import stored, table, unused_name

#: A language has to reach this score for a document to stay.
LEAST_SCORE = 0.5
#: Below this lead over the second language a prediction counts as ambiguous; documents stay all the same.
LEAST_MARGIN = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those that no language fits clearly."""
    told = unused_name("language", docs.columns)
    rows = docs.withColumn(told, langid.predictor(langid.fit(docs), LEAST_MARGIN)(F.col("text")))
    kept = (F.col(f"{told}.lang_pred") != langid.UNKNOWN) & (F.col(f"{told}.score") >= LEAST_SCORE)
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go; documents that have no words left then go with them."""
    worded = lambda t: F.coalesce(F.regexp_replace(t, r"\s+", "") != "", F.lit(False))
    had = unused_name("had_words", docs.columns)
    left = line_dedup.dedup_lines(docs.withColumn(had, worded(F.col("text"))))
    return left.where(~F.col(had) | worded(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language identification", language),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark),
    ("packing", packed),
]

#: Language scores and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
