"""The corpus pipeline: each stage filters or rewrites documents with one operator of vellum.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread
as the next stage's docs. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, langid, mixing, neardup, secrets
from vellum.plans.runtime import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior share of the best language below which a document is rejected.
LEAST_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and a key that tells rows of one doc_id, or of none, apart by their texts."""
    return docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_text"))


def _keys(rows: DataFrame) -> DataFrame:
    """The same key from (doc_id, text_hash)."""
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_text")).distinct()


KEY = ["_id", "_none", "_text"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a posterior of at least LEAST_SCORE and that are typical of it.

    Cases: null and empty texts and texts without letters are rejected, and so is everything
    where no document has a language; texts of any length are scored whole; of equal scores the
    first language counts; repeated rows and null doc_ids are judged row by row; an empty table
    gives an empty one; columns other than those of documents are dropped.
    """
    model = langid.train(docs)
    scored = langid.predict(docs, model, keep=COLUMNS)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & F.col("typical")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (5-word shingles, Jaccard of at least 0.8): the first by doc_id.

    Cases: null and empty texts are near nothing and stay; rows of equal doc_id and text become
    one; rows of one doc_id with different texts are documents of their own; a group's documents
    without a doc_id stay only if none of it has one, and then the one of the least text hash;
    texts of any length are compared whole; an empty table gives an empty one; other columns
    are dropped.
    """
    found = neardup.near_duplicates(docs, Scratch(spark, "pipeline-neardup"), words=5, num=80, den=100)
    return _keyed(docs).join(_keys(found.where("stays")), KEY, "left_semi").dropDuplicates(KEY).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edited copies included.

    Cases: null and empty texts hold nothing and stay; texts of any length are read whole; rows
    of one doc_id, or of none, are judged by their own texts; repeated rows go or stay together;
    an empty table on either side drops nothing; other columns are dropped.
    """
    rows = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-decontaminate"))
    return _keyed(docs).join(_keys(rows.where("contaminated")), KEY, "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts by a mark, overlapping ones by one, and counts n_chars anew there; every document stays.

    Cases: null and empty texts pass unchanged; texts of any length are scanned whole; repeated
    rows stay repeated; an empty table gives an empty one; other columns are dropped.
    """
    scanned = secrets.scan(docs, keep=COLUMNS, mask=True)
    text = F.coalesce("masked", "text")
    return scanned.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("masked").isNull(), F.col("n_chars")).otherwise(F.length("masked")).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents by position, repeated as their source's target asks, with take_words of each.

    Cases: texts without words take no part, nor do documents beyond their source's target; a
    null source is a source of its own; null and repeated doc_ids take part row by row; equal
    positions go by doc_id; an empty table gives an empty mix; other columns are dropped.
    """
    scratch = Scratch(spark, "pipeline-mix")
    assigned = scratch.finish(mixing.assign_positions(scratch.save(mixing.sized(docs), "sizes")))
    return mixing.mix(docs.select(*COLUMNS), assigned)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mixing", mix)]
#: Language ID and alignment have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; a stage's table is dropped when the next one is stored."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
