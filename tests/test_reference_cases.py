"""The regression cases, null rules, batch boundaries, overflow, plans, and a streaming form."""

import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions.scalar import COMPARE, arithmetic, common_type, compare_sign, date_shift, day_at_most, int_div, mixed_arithmetic
from brindle.operators import aggregate, joins
from brindle.plans import catalog, inspect
from brindle.sources import tables
from brindle.streaming.windows import tumbling_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t1(spark):
    return spark.createDataFrame([(a, b) for b in (2.3, 3.3, 4.3) for a in (1, 2, 3)], "a int, b double")


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_regression_cases(t1):
    assert len(t1.collect()) == 9
    assert rounded(t1.select("b")) == [(b,) for b in (2.3, 3.3, 4.3) for _ in range(3)]
    assert rounded(t1.select(F.col("b") + 1)) == [(b,) for b in (3.3, 4.3, 5.3) for _ in range(3)]
    assert rounded(t1.agg(F.count("b"))) == [(9,)]
    both = t1.groupBy("a").agg(F.sum("b"), F.avg("b"))
    assert rounded(both) == [(a, 9.9, 3.3) for a in (1, 2, 3)]
    assert rounded(t1.filter("a < 3").groupBy("a").agg(F.sum("b"), F.avg("b"))) == [(1, 9.9, 3.3), (2, 9.9, 3.3)]


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (None, 2.0, True), (3, 4.0, False)], "i int, d double, f boolean")
    got = rows.agg(F.count("i"), F.sum("i"), F.avg("d"), F.sum(F.col("i") * F.col("d"))).first()
    assert tuple(got) == (2, 4, 3.0, 12.0)
    assert rows.filter("f").count() == 1 and rows.filter(F.col("i") > 0).count() == 2
    assert tuple(rows.filter("i > 9").agg(F.count("i"), F.sum("i"), F.avg("d")).first()) == (0, None, None)
    assert rows.filter("i > 9").groupBy("f").count().collect() == []
    assert [r[0] for r in rows.select(compare_sign(F.col("i"), 2)).collect()] == [-1, None, 1]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4097])
def test_batch_boundaries(spark, n):
    rows = spark.range(n).withColumn("k", F.col("id") % 7)
    assert rows.agg(F.count("id")).first()[0] == n
    assert sum(r[1] for r in rows.groupBy("k").count().collect()) == n


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "float", "double"])
def test_numeric_operators(spark, kind):
    """All operators of a type against Python, with nulls and negative values."""
    values = [(7, 2), (-7, 2), (7, -2), (0, 5), (None, 1), (1, None)]
    df = spark.createDataFrame(values, "a int, b int").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    whole = kind not in ("float", "double")
    python = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: int(x / y) if whole else x / y}
    for name, op in arithmetic(kind).items():
        out = df.select(op(F.col("a"), F.col("b")).alias("x"))
        assert out.dtypes == [("x", kind)]
        assert [r.x for r in out.collect()] == [None if None in v else python[name](*v) for v in values]
    for name, op in COMPARE.items():
        assert [r[0] for r in df.select(op(F.col("a"), F.col("b"))).collect()] == [None if None in v else op(*v) for v in values]


KINDS = ["smallint", "int", "bigint", "float", "double"]


@pytest.mark.parametrize("a", KINDS)
def test_mixed_operators(spark, a):
    """Operands of two types, either way round, with a null: the result's type is the common one."""
    for b in KINDS:
        wide = common_type(a, b)
        assert wide == common_type(b, a) and (wide in (a, b) or wide == "double")
        cols = [f(F.lit(x).cast(a), F.lit(y).cast(b)).alias(f"{name}_{k}") for k, (x, y) in enumerate([(7, -2), (None, 2)]) for name, f in mixed_arithmetic(a, b).items()]
        out = spark.range(1).select(*cols)
        assert {k for _, k in out.dtypes} == {wide}
        assert tuple(out.first()) == (5, 9, -14, -3.5 if wide in ("float", "double") else -3, None, None, None, None)


@pytest.mark.parametrize("expression", ["32767S + 1S", "1 div 0", "2147483647 + 1"])
def test_overflow_and_division_by_zero_raise(spark, expression):
    with pytest.raises(Exception, match="OVERFLOW|DIVIDE_BY_ZERO"):
        spark.sql(f"select {expression}").collect()


def test_int_div_truncates(spark):
    assert spark.range(1).select(int_div(F.lit(-7), F.lit(2), "int")).first()[0] == -3


def test_days_at_most(spark):
    """Against the cast of the column, at midnight, around it, and at a limit within a day."""
    rows = spark.sql("select cast(c as timestamp_ntz) as t from values ('2024-02-28 23:59:59.999999'), ('2024-02-29 00:00:00'), ('2024-02-29 23:59:59'), ('2024-03-01 00:00:00'), (null) as v(c)")
    for limit in ("date '2024-02-29'", "timestamp_ntz '2024-02-29 12:00:00'", "timestamp_ntz '2024-02-29 00:00:00'", "cast(null as date)"):
        got = rows.select(day_at_most(F.col("t"), F.expr(limit)).alias("a"), (F.col("t").cast("date") <= F.expr(limit)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_months_clamp(spark):
    days = spark.sql("select date '2023-03-31' as d union all select date '2024-03-31' union all select null")
    got = [r[0] for r in days.select(date_shift(F.col("d"), -1, "month")).collect()]
    assert got == [datetime.datetime(2023, 2, 28), datetime.datetime(2024, 2, 29), None]


def test_infinities(spark):
    assert spark.sql("select sum(x), avg(x) from values (double('inf')), (1D) as t(x)").first()[0] == float("inf")


def test_as_of_and_range_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), ("a", 5, 49), ("b", 10, 1), (None, 1, 7)], "k string, t int, v int")
    assert {r["id"]: r["seen"] for r in joins.as_of(left, right, ["k"], "t", "v", "seen").collect()} == {1: 50, 2: None, 3: None, 4: 7}
    points, ranges = spark.range(0, 60).withColumnRenamed("id", "p"), spark.createDataFrame([(1, 3, 17), (2, 50, 50), (3, 15, 16)], "r int, low int, high int")
    got = sorted((r["p"], r["r"]) for r in joins.in_range(points, ranges, "p", "low", "high", 10).collect())
    assert got == sorted([(p, 1) for p in range(3, 17)] + [(15, 3)])


def test_grouping_sets(spark):
    rows = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 4)], "a string, b string, n int")
    got = aggregate.grouping_sets(rows, aggregate.cube_sets(["a", "b"]), F.sum("n").alias("s"))
    want = rows.cube("a", "b").agg(F.sum("n").alias("s"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_tables(spark):
    for name in tables.SCHEMAS:
        assert tables.mismatches(tables.load(spark, SF, name), name) == []
    assert tables.unsupported(tables.load(spark, SF, "embeddings"), ["vec_id", "embedding"]) == ["embedding"]


def test_plan_of_the_flagship(spark):
    got = inspect.report(catalog.queries()["tpch_q1"](spark, SF))
    assert sorted(got["read"][0]) == sorted(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    assert "l_shipdate" in got["pushed"][0] and "cast" not in got["pushed"][0] and got["exchanges"] == 1 and got["batched"]


def test_streaming_equals_batch(spark, tmp_path):
    events = tables.load(spark, SF, "events").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, tumbling_counts(events).collect()))
