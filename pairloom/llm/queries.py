"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decision_list, divergence, gray_simhash, hamming_dedup, html_template, line_crf, ngram_lm, periodic_runs, pii_crf, secret_crf, sentencepiece_codec, url_rules, winnow
from pairloom.sources.tables import table


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.learn(docs))


#: Where the tokenizer's model lies, on the driver only; the pieces travel with the tasks.
PIECES = os.environ.get("PAIRLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.Pieces.load(PIECES))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


#: The README has the figures of the check tool at this order.
ORDER = 3


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.learn(docs.where(fold(10) != 0), ORDER)
    scored = ngram_lm.score(docs, model)
    return scored.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.learn(docs, labels.where(fold(3) != 1))
    return line_crf.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_crf.find(docs, secret_crf.learn(docs))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _repeating(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a period of its own in every tenth text, told by the crc32 h of its doc_id: from word a = g % n
    on, g = h div 10, the next 1 + (n - a) div (3 + g % 8) words repeat to the end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    told = told.withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, g % n, null)"))
    told = told.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # a null first or second argument leaves the text as it is
    again = F.expr("array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p + 1))), 1, int(n - a))), ' ')")
    return told.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(_repeating(table(spark, sf_dir, "documents"))))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_benchmark_decontamination, op3_sentencepiece, op4_minhash_near_dedup, op5_quality_rules, op6_pii, op7_lm_scoring, op8_quality_classifier, op9_secret_scan, op10_url_filters, op11_source_divergence, op12_periodic_runs, op13_simhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": winnow.ORACLE, "op4_minhash_near_dedup": hamming_dedup.ORACLE, "op10_url_filters": url_rules.oracle(), "op11_source_divergence": divergence.ORACLE}
