"""Corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared folder and
reads it again as the next stage's docs, so that a lost executor costs the tasks of one stage only; a stage's table goes
when the next one is written. Null texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, table
from partloom.llm.decontaminate import find_overlaps
from partloom.llm.jaccard_join import one_of_each
from partloom.llm.language_id import fit_languages, identify
from partloom.llm.line_dedup import without_repeated_lines
from partloom.llm.piece_lattice import encode_texts

LEAST_SCORE = 0.5  # of a language's share; below it the text is as likely to be in others together


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and one language that is likelier than all others together. Learned from the rows'
    own language labels."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    known = identify(rows, fit_languages(docs)).where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}")
    return known.select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that equal or nearly equal an earlier one; n_chars follows the text."""
    left = without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item. Rows are told apart by id and text, as ids may be null or repeat."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.encode("text", "UTF-8")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col("text").alias("text"))
    found = find_overlaps(keyed.select("_key", "text"), table(spark, sf_dir, "benchmark"), id_col="_key").select("_key").distinct()
    return keyed.join(found, "_key", "left_anti").select("_row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best piece ids of every text, the scores of its N best segmentations, and whether decoding gives it back."""
    out = encode_texts(docs)
    return out.select("doc_id", F.get("pieces", F.lit(0)).alias("ids"), "scores", "decoded")


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", leaks), ("sentencepiece", pieces)]

# SimHash, min-hash, the language model and the piece lattice are not SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
