"""Session helpers of the language-model operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's folder if it names one, else (tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="brindle-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of ids that are broadcast at most.
SMALL_IDS = 16 << 20


def without(docs: DataFrame, gone: DataFrame, id_column: str) -> DataFrame:
    """docs but the rows whose id is in gone's only column; a null id is never gone.

    Where the ids are at most ``SMALL_IDS`` bytes they are broadcast and no text moves; beyond that the join shuffles.
    """
    gone = cut(gone.toDF("_gone").filter("_gone is not null"))
    size = gone.agg(F.sum(F.octet_length(F.col("_gone").cast("string")) + 16)).first()[0] or 0
    # The row travels as one struct, so that no column name of the caller's can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).alias("_key"))
    return rows.join(F.broadcast(gone) if size <= SMALL_IDS else gone, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
