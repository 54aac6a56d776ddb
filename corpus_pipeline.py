"""The corpus pipeline: language labels, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents.  Stages with a null or odd id, source or text follow the rules in their operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.exact import without_duplicates
from folioforge.llm.jaccard import near_duplicates
from folioforge.llm.langid import held_out, labelled, trained
from folioforge.llm.packing import packed
from folioforge.llm.queries import vocabulary
from folioforge.llm.secrets import redacted
from folioforge.llm.storage import drop, table, written

#: A document goes if it has no letter, or less than this share of it is in one language.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label every document; those of no language, or of too many at once, go."""
    made = labelled(docs, trained(docs.where(~held_out())))
    return made.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return without_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the smallest id stays, of equal ids that
    with the smaller hash of its text, and one without id only where no row has one.  Rows go by id and text, so one with
    the id of a row that goes stays if its own text does; rows equal in both go or stay together."""
    made = near_duplicates(docs, words=5, percent=80, keys=True)
    linked = written(made.where("component is not null").select("doc_id", "text_hash", "component"), "linked")
    drop(made)
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = linked.groupBy("component").agg(F.min(one).alias("one"), F.count("*").alias("n")).where("n > 1").drop("n")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id_")
    gone = linked.join(stays, "component").where(one != F.col("one")).select(key, F.col("text_hash").alias("hash_")).distinct()
    gone = written(gone, "near")
    drop(linked)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash_"))
    return rows.hint("merge").join(gone, ["id_", "hash_"], "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind; no document goes."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences in the proportions of the sources."""
    return packed(docs, vocabulary("word_bpe_49k.json"), digest=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: Tokenizing cannot be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = written(made, f"stage-{name}")
            drop(docs)
        docs = made
    return docs
