"""A document pipeline of five stages; each calls one operator of eventloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``.

Null ids and repeated rows: stages decide row by row, so a row with a null id stays or goes by itself, and of repeated rows
one stays in the n-gram join. Null or empty texts go with the quality rules. Empty tables pass through. Further columns of
the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import language, linededup, ngramjoin, packing, quality
from eventloom.session import load, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rows that the rules reject, as strictly as their host's verdict says, go; every row has its own verdict."""
    return quality.judge(materialise(quality.measure(docs, keep=COLUMNS))).where("kept").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a letter go, and those whose language the network is less sure of than of nearly all held-out text.

    The network learns from all labelled texts; every one of them is held out once for the floor.

    Without any label to learn from all rows stay.
    """
    model = language.fit(docs.select("doc_id", "lang", "text"))
    if model is None:
        return docs.select(*COLUMNS)
    out = language.predict(docs, model, keep=COLUMNS)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= model.floor)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: the texts lose lines that five or more documents share."""
    out = linededup.dedup(docs, keep=("doc_id", "lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked rows the one with the smallest id stays (all without words stay)."""
    return ngramjoin.representatives(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", keep_good), ("language ID", keep_known_language), ("line dedup", drop_repeated_lines), ("n-gram join", drop_near_copies), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
