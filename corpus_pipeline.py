"""The corpus pipeline: quality rules, language ID, near duplicates, personal data and packing, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last give the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, ngram_join, packing, pii, quality
from graphloom.llm.common import ensure_checkpoint_dir, table
from graphloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.4  # of the mean probability over windows: mixed languages stay, where one has two fifths


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*[df[c] for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from each text, and documents go that fail the base limits or lose too much text. Null and empty texts go."""
    out = quality.quality_rules(_columns(docs)).where("kept")
    return _columns(out.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("clean_text").cast("long")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is `und` or scores less than MIN_SCORE; lang becomes the predicted language.

    The network learns from the labelled rows of docs itself (a bounded sample); where there are none, all rows are `und` and go.
    """
    docs = _columns(docs)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = langid.train(docs.where(~held_out), "text", "lang", "doc_id")
    out = langid.identify(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _columns(out.withColumn("lang", F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, that with the smallest doc_id."""
    return _columns(ngram_join.one_of_each(ngram_join.ngram_join(_columns(docs))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets are replaced by their kind in angle brackets; n_chars follows. No document goes."""
    out = pii.find_pii(_columns(docs), key_col="doc_id")
    return _columns(out.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("redacted").cast("long")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with the sequence and the place there of each."""
    out = packing.pack_documents(docs.select("doc_id", "text"), vocabulary(), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the byte network, the trees and the vocabulary.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
