"""A training corpus from the table of documents: filter by quality and language, drop near copies, mix, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archlake.llm import gam, jaccard, langid, mixing, packing
from archlake.llm.queries import fold
from archlake.llm.store import cut, table

#: A document with a lower score is rejected.
QUALITY = 0.3

#: Near copies share shingles of five words and at least 0.8 of their shingles.
NEAR = jaccard.Rule(words=5, num=80, den=100)

WINDOW, END_ID = 2048, 1

#: Before the names of columns that a stage makes for itself, so that no column of the documents is in the way.
OWN = "pipeline__"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under QUALITY; empty and null texts have a score like any other.

    Learns from labelled documents of this stage's input; without any, all documents stay.
    """
    model = gam.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return gam.score(docs, model, docs.columns, name=OWN + "score").where(F.col(OWN + "score") >= QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those in none of the learnt languages.

    Without a document with a lang to learn from nothing is rejected.
    """
    model = langid.train(docs, F.coalesce(fold(4) != 2, F.lit(True)))
    if model is None:
        return docs
    return langid.identify(docs, model, docs.columns, prefix=OWN).where(OWN + "accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that with the smallest id; of equal rows (id and text) a single one.

    Rows with one id and different texts are documents of their own. Documents without words link with nothing and stay; so do
    all rows without an id.
    """
    gone = cut(jaccard.copies(docs.select("doc_id", "text"), NEAR).select(F.col("doc_id").alias(OWN + "id"), F.col("h").alias(OWN + "h")))
    text = F.col(OWN + "h").isNull() | (F.col(OWN + "h") == jaccard.text_hash("text"))
    kept = docs.join(gone, (F.col("doc_id") == F.col(OWN + "id")) & text, "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        again = cut(again)
        one = Window.partitionBy("doc_id", jaccard.text_hash("text")).orderBy("text", *[c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind])
        several = kept.join(again, "doc_id", "left_semi").withColumn(OWN + "n", F.row_number().over(one)).where(F.col(OWN + "n") == 1).drop(OWN + "n")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(several)
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: sources alternate by the square root of their size (null is a source)."""
    placed = mixing.mix(docs, mixing.tempered_weights(docs), prefix=OWN)
    order = [F.col(OWN + "slot").asc_nulls_last(), F.col(OWN + "row_in_block")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns)


def placed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with the place of each row in its table, and the names of these columns: number of the part file, file, row in it.

    Spark numbers part files by partition, so that this is the order in which the stage before wrote its rows.
    """

    def named(table: DataFrame) -> DataFrame:
        at = table.metadataColumn("_metadata")
        part = F.coalesce(F.expr(f"try_cast(regexp_extract({OWN}file, '^part-([0-9]+)', 1) as bigint)"), F.lit(0).cast("long"))
        return table.select("*", at["file_name"].alias(OWN + "file"), at["row_index"].alias(OWN + "row")).withColumn(OWN + "part", part)

    try:
        found = named(docs)
    except AnalysisException:  # not read from one table
        found = named(cut(docs))
    return found, (OWN + "part", OWN + "file", OWN + "row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of tokens; an empty or null text is its end id alone.

    Pieces of one length, and sequences by their first piece, are in the order of the rows, which is the mix.
    """
    found, order = placed(docs)
    return packing.pack(found, public_tokenizers.path("byte_bpe_50k.json"), window=WINDOW, end_id=END_ID, order=order)


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the learnt models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
