"""Exact dedup by skew-safe combining, in DataFrame functions alone.

Texts are equal when they are identical after each run of ASCII white space has become
one space. Three stages, each comparing the digest *and* the whole text:

1. each task combines its own equal texts (the partial aggregate of the first group-by);
2. groups of one digest are merged within a salt, so that a text that a third of all
   rows hold is spread over ``salts`` tasks;
3. the winners of the salts are combined globally.

After stage 3 a digest stands for one text; the rare digest of several texts is told by
counting, and its rows are then matched by their whole text.

Defined cases: a null text counts as empty; of rows with equal texts that repeat the
smallest ``doc_id`` one stays; rows with a null ``doc_id`` stay only if no row of their
group has an id (one does); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SPACE = r"[ \t\n\x0B\f\r]+"
SALTS = 16


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Of each distinct text: ``sha`` (its digest), ``body``, ``keep_id``, ``group_size``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("sha", "body", "salt").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("sha")
    return merged.groupBy("sha", "body").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = winners(docs, salts).groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    found = checkpointed(found)
    body = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"))
    same = Window.partitionBy("sha", "doc_id").orderBy("doc_id")
    rows = rows.withColumn("nth", F.row_number().over(same))
    out = rows.join(found.filter("texts = 1"), "sha")
    clash = found.filter("texts > 1").select("sha")
    if clash.limit(1).count():
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256)))
        texts = texts.join(clash, "sha", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("sha", "body", "doc_id").orderBy("doc_id")))
        exact = winners(docs, salts).join(clash, "sha", "left_semi")
        out = out.drop("texts").unionByName(texts.join(exact, ["sha", "body"]).drop("body"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
