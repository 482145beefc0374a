"""The tables and their expected schemas; parquet is read with the columns that a query names and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

#: The types that expressions are defined on; columns of other types pass only where nothing reads them.
SUPPORTED = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.DateType, T.TimestampNTZType)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mismatches(df: DataFrame, name: str) -> list[str]:
    """What differs from the expected schema: columns that are missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = T.StructType.fromDDL(SCHEMAS[name])
    return [f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType}" for f in want.fields if have.get(f.name) != f.dataType]


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of tables, for SQL text."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def unsupported(df: DataFrame, columns: list[str]) -> list[str]:
    """Of these columns, those whose type expressions aren't defined on."""
    return [c for c in columns if not isinstance(df.schema[c].dataType, SUPPORTED)]
