"""A training corpus from documents: quality, exact and near duplicates, source mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import exact_dedup, mixing, ngram_join, packing, quality
from causeway.llm.frames import written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, fitted on the labelled ones, do not reject.

    Null and empty texts are judged as empty ones, very long ones whole; copies and
    rows given twice stay or go together. Without labels none is rejected. An empty
    table stays empty. All columns pass.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model, least=LEAST_QUALITY)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the smallest id, null ids last.

    Null, empty and white-space texts are as many texts as they differ in after runs of
    white space become one space; null is empty. Of rows given twice one stays. An empty
    table stays empty. All columns pass.
    """
    return exact_dedup.drop_duplicates(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Documents without words link with nothing and stay. Very long texts are compared
    whole. An empty table stays empty. All columns pass.
    """
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws, in its order, once for each draw, twice at most.

    Null texts count no words and are drawn with their block; a null source is one of
    its own. An empty table, or one without words, gives an empty one. All columns pass.
    """
    return mixing.plan_mix(docs).rows(keep=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the drawn documents in sequences of 2048 tokens.

    Every row is packed, those given twice too; null and empty texts are the end id
    alone, and only documents over 2048 tokens are cut. An empty table stays empty.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_dissimilar),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier's trees and the mixture's draws are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next.

    Columns beyond doc_id, text and source pass through the first four stages, whatever
    their names. An empty table of documents gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
