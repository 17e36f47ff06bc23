"""The queries of this subpackage; each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialise
from . import fingerprints, hmm, htmltext, language, linededup, ngramjoin, packing, pieces, quality, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def fold(remainder: int) -> Column:
    """Whether crc32 of doc_id as text, modulo 5, is ``remainder`` (a null id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return tokencount.count_edits(docs.select("doc_id", "text", tokencount.sample_edits().alias("edits")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.fit(docs, ~fold(0), per_lang=1500)
    return language.predict(docs, model).select("doc_id", fold(0).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(load(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(quality.measure(load(spark, sf_dir, "documents")))
    out = quality.judge(measured)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.score(docs, hmm.fit(docs.where(~fold(1)).select("text")), fold(1))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": op2_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_hidden_markov": op7_hidden_markov,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
}
