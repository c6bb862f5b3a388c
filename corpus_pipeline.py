"""Corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, personal data is
replaced, and what is left is packed into sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and hands it to the next stage. All stages but the last return the columns of ``documents``; ``n_chars``
follows ``text``. Rows with null text or doc_id go through as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm import line_dedup, ngram_join, packing, surrogates, toxicity
from woonvonk.llm.common import table, written


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` as the texts are now."""
    kind = dict(like.dtypes).get("n_chars")
    return docs.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones of ``docs``, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumnRenamed("score", "__score"), model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score").withColumnRenamed("__score", "score").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that the largest document holding them keeps; every document stays."""
    index = line_dedup.build(docs)
    return _sized(line_dedup.apply(index, docs, index.postings), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies; documents without words, id or links stay."""
    lost = ngram_join.grouped(docs).where("doc_id <> component_id").select("doc_id").distinct()
    lost = written(lost, "near-copies")
    return docs.join(lost.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets; every document stays."""
    return _sized(surrogates.replaced(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("personal data", without_personal_data),
    ("best-fit packing", packed),
]

# The classifier and the tokenizer are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
