"""A training corpus from raw documents: quality rules, near-dedup, decontamination, redaction, tokens.

Each stage works on all rows that the one before it kept and returns the columns of documents; the last one returns
doc_id, n_tokens, token_ids and round_trip. Columns beside those of documents travel along, whatever their names. Empty
tables give empty results, and texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decision_list, hamming_dedup, pii_crf, sentencepiece_codec, winnow
from pairloom.llm.queries import PIECES
from pairloom.sources.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned list rejects.

    Null and empty texts have no words and go. Repeated rows are judged one by one, also without a doc_id; a doc_id with
    several labels counts as rejected if any says so. Without labels the base rule decides alone.
    """
    return decision_list.keep_good(docs, decision_list.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near-duplicates.

    Null and empty texts are linked with nothing and stay. Repeated rows of one doc_id stay once. Rows without a doc_id take
    no part and stay. The least doc_id is the only choice, so there are no ties.
    """
    return hamming_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; null and empty items have no windows. Repeated rows are judged one by one. An
    item without an item_id counts.
    """
    return winnow.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds, and brings n_chars up to date.

    Null and empty texts stay as they are. Repeated rows give repeated results. Where spans overlap, the first one's kind is
    named, on ties the longest one's.
    """
    return pii_crf.redact(docs, pii_crf.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document.

    Null and empty texts have none. Repeated rows give repeated results. Of segmentations of one score, the one with the
    longest last piece is taken.
    """
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Pieces.load(PIECES))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_pii", redact_pii), ("encode", encode)]

#: Learned rules and a learned field have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs, name) if k else docs, sf_dir)
    return docs
