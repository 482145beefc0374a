"""Aggregation: null-skipping counts, sums and averages, filtered and distinct ones, and grouping sets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(aggregate, value: Column, condition: Column) -> Column:
    """The aggregate over the rows that meet the condition."""
    return aggregate(F.when(condition, value))


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """One result for all grouping sets, from one pass; keys outside a row's set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates)


def cube_sets(keys: list[str]) -> list[list[str]]:
    return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def salted_sum(df: DataFrame, keys: list[str], value: str, name: str, buckets: int = 64) -> DataFrame:
    """Sum by keys in two steps, for inputs that map-side combine can't shrink (keys nearly as many as rows, one hot)."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
    part = df.groupBy(*keys, salt.alias("_salt")).agg(F.sum(value).alias("_part"))
    return part.groupBy(*keys).agg(F.sum("_part").alias(name))
