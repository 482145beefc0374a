"""Chat formatting: logged snapshots collapse into the conversations that contain them; DataFrame functions only.

Turn by turn, a rolling hash of 128 bits identifies a conversation's prefix: the exclusive or of hashes of
(position, role, text), so each turn's prefix hash is a running aggregate. A conversation whose whole hash is
the hash of a proper prefix of another is a snapshot of it and goes (an anti-join of two tables without repeats);
of equal conversations the smallest id stays. What is left is rendered, one text for each conversation.

Defined cases: rows without a conversation id belong to none and are left out; turns are ordered by turn, role and
text, nulls first, so ties and repeated rows have one order; a null role or text renders as empty but differs from
an empty one in comparison; a conversation's rows must fit one task, as its rendered text does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import load


def turn_hash(salt: int):
    return F.xxhash64(F.lit(salt), "pos", F.coalesce("role", F.lit("")), F.isnull("role"), F.coalesce("text", F.lit("")), F.isnull("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, n_turns, and a, b: the hash of the turns up to this one."""
    turns = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = turns.withColumn("pos", F.row_number().over(order)).withColumn("_a", turn_hash(1)).withColumn("_b", turn_hash(2))
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id", "pos", "role", "text", F.count(F.lit(1)).over(whole).alias("n_turns"), F.bit_xor("_a").over(so_far).alias("a"), F.bit_xor("_b").over(so_far).alias("b")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id of the conversations that no other one contains as a prefix, one of each that are equal."""
    ends = rows.filter("pos = n_turns").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = rows.filter("pos < n_turns").select("pos", "a", "b").distinct()
    return ends.join(inner, ["pos", "a", "b"], "left_anti").select("conv_id")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the conversations that stay."""
    rows = prefixes(turns)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    kept = rows.join(maximal(rows), "conv_id", "left_semi").select("conv_id", F.struct("pos", line.alias("line")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"])
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(lines, "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(load(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id),
heads AS (SELECT DISTINCT turns[1:k] AS head FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
one AS (SELECT min(conv_id) AS conv_id FROM c LEFT JOIN heads ON c.turns = heads.head WHERE heads.head IS NULL GROUP BY turns)
SELECT c.conv_id, c.n_turns, c.rendered FROM c JOIN one ON c.conv_id = one.conv_id
"""
