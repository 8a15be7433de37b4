"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.decontaminate import WINDOW, contaminated
from quarry.llm.language import held_out, identified, trained
from quarry.llm.minhash import deduplicated
from quarry.llm.pieces import Vocabulary, encoded
from quarry.llm.queries import table
from quarry.llm.suffix_array import PASSAGE, WORD
from quarry.llm.suffix_array import deduplicated as without_repeats

#: SQL can't express the language model, the removal of byte strings or the segmentation; tests hold run() against brute force.
ORACLE_SQL = None
#: Below this share of letters in its own language, a text has no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: no letters, or no language with half of them.  ``lang`` becomes the predicted one."""
    model = trained(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identified(docs, model).where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("_lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return deduplicated(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in another document too are removed; documents with no word left go."""
    out = without_repeats(docs, length=PASSAGE, unit="word", across=True)
    out = out.withColumn("text", F.when(F.col("_n_removed") == 0, F.col("text")).otherwise(F.col("_kept").cast("string")))
    out = out.where((F.col("_n_removed") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(F.col("_n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with eight words in a row from benchmark items go: those don't meet by chance.  The words of a shorter
    item do, so by itself it drops only a document that holds nothing else; neighbouring items count together.  (The
    threshold of two items is that of the op6 query alone.)"""
    own = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = contaminated(own, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("_hit", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    bad = F.exists("_hit", lambda x: x.end - x.start >= WINDOW) | ((F.col("_n") > 0) & (covered == F.col("_n")))
    return found.where(~bad).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces."""
    return encoded(docs.select("doc_id", "lang", "text"), Vocabulary.load()).select("doc_id", "lang", F.col("_n").alias("n_ids"), F.col("_ids").alias("ids"), F.col("_lossless").alias("lossless"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", exact_dedup), ("decontaminate", decontaminate), ("pieces", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
