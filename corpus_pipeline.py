"""A corpus from documents to packed sequences: five stages, each rereading what the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder.

Defined cases, for all stages: a null text counts as empty and stays null; a null or repeated
``doc_id`` is no reason to go, as a row is told by its id and a hash of its text; rows that are
there twice are judged alike, and the near-copy stage leaves one of them; very long texts are
taken whole; columns beside ``doc_id`` and ``text``, whatever their names, are handed on by all
but the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriflux.llm import decontamination, line_dedup, packing, simhash, toxicity
from veriflux.llm.common import fresh_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled ones among ``docs``. Empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(_told_apart(docs), model).filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line go, equal or within one edit; all documents stay, ``n_chars`` follows the text."""
    return line_dedup.line_dedup(docs, count=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays (null ids last). Empty texts are one group."""
    return simhash.first_of_groups(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or as a paraphrase, go; the index is fitted on all passages."""
    return _without(docs, decontamination.find_leaks(_told_apart(docs), table(spark, sf_dir, "benchmark"), max_fit_passages=None))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op5_packing gives them, with a checksum in place of the ids; an empty text is its end id alone."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _row(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` for an operator, with an id that tells rows with a null or the same ``doc_id`` apart."""
    return docs.select(_row(docs).alias("doc_id"), docs["text"])


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ids of ``_told_apart`` are in ``found``."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that can't clash
    rows = docs.select("*", _row(docs)).toDF(*own, "own_row")
    gone = found.select(F.col("doc_id").alias("gone_row")).distinct()
    return rows.join(gone, F.col("own_row") == F.col("gone_row"), "left_anti").drop("own_row").toDF(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES``, one after another, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
