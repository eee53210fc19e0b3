"""A training-text pipeline over ``documents``: five stages that each apply one text operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of ``documents``. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import bpe, decontaminate, lines, ngram_join, quality
from shopfloor.llm.common import table
from shopfloor.llm.queries import WORD_BPE
from shopfloor.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule, or whose likelihood ratio is below the threshold, go.

    A null or empty text has too few words and goes. Every row is judged by its own text, whatever its id.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or similar to an earlier one go, and with them documents of which nothing is left; ``n_chars`` follows the text.

    A null text stays. Rows of one id and text are one document, kept or cut alike; a null id comes first.
    """
    kept = lines.without_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id, null first.

    Rows of one id with other texts are documents of their own. Texts without words are no copies of one another.
    """
    return ngram_join.first_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their id; a null text and an empty benchmark remove nothing."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded text of every row left; a null text counts as empty."""
    return bpe.token_digests(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: None: SQL has neither the hash of the quality rules nor the merges of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
