"""Exact deduplication: 128-bit content hash groups, smallest id stays, bytes compared inside groups.

Texts are equal when identical after each run of ASCII white space becomes one space. One aggregate groups by the
128-bit hash of that form and, inside a hash, by the form's bytes, so a hash that stands for several texts splits there.
It combines before its shuffle, so a group of any size sends one row from each input partition.

Every row then gets its group's verdict by (hash, sha256, salt). The salt is the number of the row's input partition
modulo ``SALTS``, and the groups' side is spread only over the salts at which a group has rows. So the rows of a hot
text meet in up to ``SALTS`` tasks, and no join moves a text.

Defined cases: a null text counts as empty; empty texts are copies of each other; rows that repeat both id
and text all count in ``group_size`` and share one verdict; a null id never wins over another id, and
:func:`drop_copies` never drops a row without an id; an empty table gives an empty result; further columns pass through untouched in :func:`drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, load, text_or_empty, without

SALTS = 256


def normal_form(text: Column) -> Column:
    # Single spaces are runs too, but already what they become.
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(form: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(form))


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed=content_hash) -> DataFrame:
    """One row per document: _id, keep_id, group_size, text_sha256.

    hashed: maps the normal form to the grouping key; tests pass a poor one to force collisions.
    """
    rows = docs.select(F.col(id_column).alias("_id"), normal_form(text_or_empty(text_column)).alias("_form"))
    rows = rows.withColumn("_hash", hashed(F.col("_form")))
    sha = F.sha2(F.col("_form"), 256).alias("text_sha256")
    texts = rows.groupBy("_hash", "_form").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    several = texts.filter("_rows > 1").select("_hash", sha, "_first", "_rows")
    slim = cut(rows.select("_id", "_hash", sha, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt")))
    keys = ["_hash", "text_sha256"]
    spread = cut(slim.select(*keys, "_salt").distinct().join(several, keys))
    found = slim.join(spread, [*keys, "_salt"], "left")
    alone = F.col("_rows").isNull()
    return found.select("_id", "text_sha256", F.when(alone, F.col("_id")).otherwise(F.col("_first")).alias("keep_id"), F.coalesce("_rows", F.lit(1)).alias("group_size"))


def label(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return classes(docs, id_column, text_column).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = classes(docs, id_column, text_column).filter(~F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id")
    return without(docs, gone, id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS form FROM documents),
g AS (SELECT form, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY form)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.form) AS text_sha256
FROM d JOIN g ON d.form = g.form
"""
