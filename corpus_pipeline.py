"""Corpus preparation: language ID, quality, exact dedup, near dedup, packing.

Each stage takes the table its predecessor wrote and applies one operator to all of it; its
decisions take effect on the rows that go on. All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

For all stages: rows are told apart as rows, so null and repeated identifiers are no special case; null
and empty texts are treated as each operator states; very long texts are taken whole; an empty table
gives an empty one; columns beyond those of ``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefut.llm import common, exact_dedup, language_id, ngram_join, packing, quality
from tidefut.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = COLUMNS[1:]
#: Documents whose best language is less likely than this are rejected.
LEAST_LANG_SCORE = 0.34
#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.3


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without a letter, and those whose best language is too unlikely. Ties go to the language that sorts first."""
    found = language_id.language_id(docs, vocabulary("piece_bpe_32k.model"), carry=OTHERS)
    kept = found.toDF("doc_id", "held_out", "lang_pred", "lang_score", "n_words", *OTHERS)
    return kept.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANG_SCORE)).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored as empty ones, repeated rows alike."""
    found = quality.quality(docs, table(spark, sf_dir, "labels"), threshold=LEAST_QUALITY, carry=OTHERS)
    return found.where("predicted = 1").select(*COLUMNS)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) one row stays, the one with the largest identifier; of rows that repeat both, any one."""
    return exact_dedup.keep_documents(docs).select(*COLUMNS)


def stage_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest identifier stays, one without identifier only if all have none.

    Documents without words are near copies of nothing and stay. Rows are told apart by identifier and text, as identifiers
    may be null or stand on several texts; of rows that repeat both, one stays.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), sha.alias("sha"))
    rows = docs.select(key.alias("doc_id"), "text")
    # a class is named by its least key: the row that stays
    found = common.materialize(ngram_join.jaccard_join(rows).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "pipeline-near")
    keyed = docs.select(key.alias("doc_id"), F.struct(*COLUMNS).alias("row"))
    kept = exact_dedup.only(keyed, found.where("not stays").select("doc_id"), "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id"]) if repeated else kept).select("row.*")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of bounded length; one row for each piece. Null and empty texts hold the end mark only, repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", stage_language_id),
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("ngram_jaccard", stage_ngram_jaccard),
    ("packing", stage_packing),
]

#: The learned stages have no SQL form; tests/llm/test_pipeline.py compares every stage, and all of them together, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
