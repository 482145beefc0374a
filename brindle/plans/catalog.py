"""The query catalogue: every operator of the engine over the tables, with the same query for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import COMPARE, INTEGERS, arithmetic, common_type, compare_sign, date_shift, day_at_most, mixed_arithmetic, shift
from ..operators import aggregate, joins
from ..sources.tables import load, views
from ..streaming.windows import tumbling_counts
from .sql_texts import ORACLE, SPARK

C = F.col
KEYS = ["l_orderkey", "l_linenumber"]
#: Name of each numeric type: Spark's and DuckDB's own, two columns of it, and a constant.
NUMBERS = {"int2": ("smallint", "s", "s2", "3"), "int4": ("int", "i", "i2", "3"), "int8": ("bigint", "b", "b2", "3"), "float4": ("float", "f", "f2", "0.5"), "float8": ("double", "d", "d2", "0.25")}
#: The same expressions in both engines.
NUMERIC_COLUMNS = {
    "s": "cast(l_linenumber as smallint)", "i": "l_linenumber", "b": "l_orderkey", "f": "cast(l_discount as float)", "d": "l_quantity",
    "s2": "cast(l_suppkey % 100 as smallint)", "i2": "cast(l_suppkey as int)", "b2": "l_partkey", "f2": "cast(l_tax as float)", "d2": "l_extendedprice",
}
SIGNS = {"gt": ">", "ge": ">=", "eq": "=", "ne": "<>", "lt": "<", "le": "<="}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def family(*names: str):
    """Register queries that one function builds; columns need a running session, so it is called with the query."""

    def register(build):
        for name in names:
            QUERIES[name] = lambda spark, sf_dir, name=name: build()[name](spark, sf_dir)
        return build

    return register


def numeric(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(*KEYS, *[F.expr(e).alias(n) for n, e in NUMERIC_COLUMNS.items()])


NUMERIC_SQL = "(select l_orderkey, l_linenumber, " + ", ".join(f"{e} as {n}" for n, e in NUMERIC_COLUMNS.items()) + " from lineitem) t"


def arith(name: str):
    kind, a, b, _ = NUMBERS[name]
    ops = arithmetic(kind)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y, three, one = C(a), C(b), F.lit(3).cast(kind), F.lit(1).cast(kind)
        cols = []
        for group, left, right in (("vv", x, y), ("vc", x, three), ("cv", three, x)):
            for op, f in ops.items():
                # Columns can be zero, so what divides is one more.
                cols.append(f(left, right + one if op == "div" and group != "vc" else right).alias(f"{group}_{op}"))
        return numeric(load(spark, sf_dir, "lineitem")).select(*KEYS, *cols)

    return run


def arith_sql(name: str) -> str:
    kind, a, b, _ = NUMBERS[name]
    sign = {"add": "+", "sub": "-", "mul": "*", "div": "//" if kind in INTEGERS else "/"}
    three, one = f"cast(3 as {kind})", f"cast(1 as {kind})"
    cols = []
    for group, left, right in (("vv", a, b), ("vc", a, three), ("cv", three, a)):
        cols += [f"cast({left} {s} {f'({right} + {one})' if op == 'div' and group != 'vc' else right} as {kind}) as {group}_{op}" for op, s in sign.items()]
    return f"select l_orderkey, l_linenumber, {', '.join(cols)} from {NUMERIC_SQL}"


def arith_const(name: str):
    """A column of one type and a constant of each type."""
    kind, column, *_ = NUMBERS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = []
        for other, (kind2, _, _, value) in NUMBERS.items():
            constant = F.expr(f"cast({value} as {kind2})")
            cols += [f(C(column), constant).alias(f"{op}_{other}") for op, f in mixed_arithmetic(kind, kind2).items()]
        return numeric(load(spark, sf_dir, "lineitem")).select(*KEYS, *cols)

    return run


def arith_const_sql(name: str) -> str:
    kind, column, *_ = NUMBERS[name]
    cols = []
    for other, (kind2, _, _, value) in NUMBERS.items():
        wide = common_type(kind, kind2)
        sign = {"add": "+", "sub": "-", "mul": "*", "div": "//" if wide in INTEGERS else "/"}
        cols += [f"cast(cast({column} as {wide}) {s} cast(cast({value} as {kind2}) as {wide}) as {wide}) as {op}_{other}" for op, s in sign.items()]
    return f"select l_orderkey, l_linenumber, {', '.join(cols)} from {NUMERIC_SQL}"


def compare(name: str, constant: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, counts = C(NUMBERS[name][1]), []
        for other, (kind, _, column, value) in NUMBERS.items():
            right = F.expr(f"cast({value} as {kind})") if constant else C(column)
            counts += [F.count_if(f(left, right)).alias(f"{op}_{other}") for op, f in COMPARE.items()]
        return numeric(load(spark, sf_dir, "lineitem")).agg(*counts)

    return run


def compare_sql(name: str, constant: bool) -> str:
    counts = []
    for other, (kind, _, column, value) in NUMBERS.items():
        right = f"cast({value} as {kind})" if constant else column
        counts += [f"count(*) filter (where {NUMBERS[name][1]} {s} {right}) as {op}_{other}" for op, s in SIGNS.items()]
    return f"select {', '.join(counts)} from {NUMERIC_SQL}"


def as_sql(name: str):
    tables, text = SPARK[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(text)

    return run


# -- scan, project, filter --------------------------------------------------------------------------------------


@query
def scan_full_row(spark, d):
    return load(spark, d, "region")


@query
def scan_passthrough_types(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", C("l_linenumber").cast("smallint").alias("c_int2"), C("l_linenumber").alias("c_int4"), C("l_partkey").alias("c_int8"), C("l_discount").cast("float").alias("c_float4"),
        C("l_quantity").alias("c_float8"), (C("l_linenumber") > 3).alias("c_bool"), C("l_returnflag").alias("c_text"), C("l_shipdate").cast("date").alias("c_date"), C("l_shipdate").alias("c_timestamp"),
    )


@query
def project_column(spark, d):
    return load(spark, d, "lineitem").select("l_quantity")


@query
def project_computed(spark, d):
    return load(spark, d, "lineitem").select(*KEYS, (C("l_quantity") + 1).alias("quantity_plus_one"))


def disc_price():
    return C("l_extendedprice") * (1 - C("l_discount"))


@query
def project_q1_exprs(spark, d):
    return load(spark, d, "lineitem").select(*KEYS, disc_price().alias("disc_price"), (disc_price() * (1 + C("l_tax"))).alias("charge"))


def lines(condition, *more):
    return lambda spark, d: load(spark, d, "lineitem").filter(condition).select(*KEYS, *more)


def nulled():
    return F.nullif(C("l_linenumber"), F.lit(3))


@family("filter_single", "filter_conjunction", "filter_null_is_not_true", "date_le_date", "date_le_timestamp", "fb_or_not", "fb_is_null", "fb_in_list", "fb_text_predicate", "fb_const_on_left_cmp")
def filters():
    return {
        "filter_single": lines(C("l_quantity") < 10),
        "filter_conjunction": lines((C("l_quantity") >= 10) & (C("l_quantity") <= 20) & (C("l_discount") > 0.05), "l_quantity"),
        "filter_null_is_not_true": lines(nulled() <= 4),
        "date_le_date": lines(day_at_most(C("l_shipdate"), F.expr("date '1998-08-17'"))),
        "date_le_timestamp": lines(day_at_most(C("l_shipdate"), F.expr("timestamp_ntz '1998-08-17 12:00:00'"))),
        "fb_or_not": lines((C("l_quantity") < 5) | ~(C("l_discount") < 0.09)),
        "fb_is_null": lines(nulled().isNull()),
        "fb_in_list": lines(C("l_linenumber").isin(1, 3)),
        "fb_text_predicate": lines(C("l_returnflag") == "R"),
        "fb_const_on_left_cmp": lines(F.lit(5) > C("l_linenumber")),
    }


@query
def filter_bool_column(spark, d):
    return load(spark, d, "lineitem").select(*KEYS, (C("l_linenumber") > 3).alias("flag")).filter("flag").select(*KEYS)


@query
def filter_empty_result(spark, d):
    return load(spark, d, "lineitem").filter(C("l_quantity") < 0).select("l_orderkey")


# -- dates ------------------------------------------------------------------------------------------------------


@query
def date_minus_interval(spark, d):
    day = C("o_orderdate").cast("date")
    return load(spark, d, "orders").select("o_orderkey", date_shift(day, -106, "day").alias("d106"), date_shift(day, -1, "month").alias("m1"))


def moved(sign: int):
    return lambda spark, d: load(spark, d, "events").select("event_id", *[shift(C("ts"), sign * n, unit).alias(c) for c, n, unit in (("m", 1, "month"), ("d", 2, "day"), ("t", 90, "minute"))])


@family("timestamp_plus_interval", "timestamp_minus_interval")
def moves():
    return {"timestamp_plus_interval": moved(1), "timestamp_minus_interval": moved(-1)}


@query
def timestamp_cmp_sign(spark, d):
    return load(spark, d, "events").select("event_id", compare_sign(C("ts"), F.expr("timestamp_ntz '2024-01-15 00:00:00'")).alias("c"))


# -- aggregates -------------------------------------------------------------------------------------------------


def plain(*aggregates, where=None):
    return lambda spark, d: (load(spark, d, "lineitem").filter(where) if where is not None else load(spark, d, "lineitem")).agg(*aggregates)


def grouped(keys, *aggregates, where=None, table="lineitem", having=None):
    def run(spark, d):
        rows = load(spark, d, table)
        rows = rows.filter(where) if where is not None else rows
        found = rows.groupBy(*keys).agg(*aggregates)
        return found.filter(having) if having is not None else found

    return run


Q = "l_quantity"

@family("agg_plain_count", "agg_plain_count_star", "agg_plain_sum_int4", "agg_plain_sum_float8", "agg_plain_avg_float8", "agg_plain_empty_input", "agg_hash_empty_input", "agg_group_single_key", "agg_group_multi_key", "agg_group_filtered", "agg_group_key_date", "agg_group_key_null", "agg_null_inputs", "agg_high_cardinality", "agg_computed_argument", "agg_shared_state", "agg_count_distinct", "agg_filter_clause", "agg_having", "agg_min_max")
def aggregates():
    return {
        "agg_plain_count": plain(F.count("l_discount").alias("n")),
        "agg_plain_count_star": plain(F.count(F.lit(1)).alias("n")),
        "agg_plain_sum_int4": plain(F.sum("l_linenumber").alias("s")),
        "agg_plain_sum_float8": plain(F.sum(Q).alias("s")),
        "agg_plain_avg_float8": plain(F.avg(Q).alias("a")),
        "agg_plain_empty_input": plain(F.count(Q).alias("n"), F.sum(Q).alias("s"), F.avg(Q).alias("a"), where=C(Q) < 0),
        "agg_hash_empty_input": grouped(["l_returnflag"], F.count(Q).alias("n"), where=C(Q) < 0),
        "agg_group_single_key": grouped(["l_linenumber"], F.count(Q).alias("n"), F.sum("l_linenumber").alias("si"), F.sum(Q).alias("sd"), F.avg(Q).alias("ad")),
        "agg_group_multi_key": grouped(["l_returnflag", "l_linestatus"], F.sum(Q).alias("sum_qty"), F.avg(Q).alias("avg_qty")),
        "agg_group_filtered": grouped(["l_linenumber"], F.sum(Q).alias("s"), F.avg(Q).alias("a"), where=C("l_linenumber") < 3),
        "agg_group_key_date": grouped([C("o_orderdate").cast("date").alias("d")], F.count("o_orderkey").alias("n"), table="orders"),
        "agg_group_key_null": grouped([nulled().alias("k")], F.count(Q).alias("n")),
        "agg_null_inputs": grouped(["l_returnflag"], F.count(nulled()).alias("n"), F.sum(nulled()).alias("si"), F.avg(F.nullif(C(Q), F.lit(10.0))).alias("a")),
        "agg_high_cardinality": grouped(["l_orderkey"], F.count(Q).alias("n"), F.sum(Q).alias("s")),
        "agg_computed_argument": grouped(["l_returnflag"], F.round(F.sum(disc_price()), 2).alias("disc_price")),
        "agg_shared_state": grouped(["l_linenumber"], F.avg(Q).alias("a1"), F.avg(Q).alias("a2"), F.sum(Q).alias("s")),
        "agg_count_distinct": grouped(["l_returnflag"], F.count_distinct("l_partkey").alias("n")),
        "agg_filter_clause": grouped(["l_returnflag"], aggregate.where(F.count, C(Q), C("l_linenumber") < 3).alias("n"), aggregate.where(F.sum, C(Q), C("l_linenumber") < 3).alias("s")),
        "agg_having": grouped(["l_linenumber"], F.sum(Q).alias("s"), having=C("s") > 217500),
        "agg_min_max": grouped(["l_returnflag"], F.min(Q).alias("mn"), F.max("l_shipdate").alias("mx")),
    }


@query
def distinct_single(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag").distinct()


@query
def distinct_multi(spark, d):
    return load(spark, d, "lineitem").filter(C(Q) > 40).select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query
def group_no_aggregate(spark, d):
    return load(spark, d, "lineitem").select("l_linenumber").dropDuplicates()


@query
def tpch_q1(spark, d):
    """Pricing summary, the flagship."""
    rows = load(spark, d, "lineitem").filter(day_at_most(C("l_shipdate"), F.expr("date '1998-12-01' - interval '106' day")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(Q).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(disc_price()), 2).alias("sum_disc_price"),
        F.round(F.sum(disc_price() * (1 + C("l_tax"))), 2).alias("sum_charge"), F.avg(Q).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("l_discount").alias("count_order"),
    )


@query
def agg_rollup(spark, d):
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(Q).alias("s"))


@query
def agg_cube(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(Q).alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"))


@query
def agg_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, d, "orders").select("o_orderkey", F.sum("o_orderkey").over(w).alias("r"))


@query
def agg_salted_sum(spark, d):
    return aggregate.salted_sum(load(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "s")


# -- joins and set operations -----------------------------------------------------------------------------------


def customers_and_orders(how, *columns, orders_where=None):
    def run(spark, d):
        o = load(spark, d, "orders")
        o = o.filter(orders_where) if orders_where is not None else o
        c = load(spark, d, "customer")
        return c.join(o, c["c_custkey"] == o["o_custkey"], how).select(*columns)

    return run


@family("fb_inner_join", "fb_left_join", "fb_semi_join", "fb_anti_join")
def customer_joins():
    return {
        "fb_inner_join": customers_and_orders("inner", "o_orderkey", "c_name"),
        "fb_left_join": customers_and_orders("left", "c_custkey", "o_orderkey"),
        "fb_semi_join": customers_and_orders("left_semi", "c_custkey"),
        "fb_anti_join": customers_and_orders("left_anti", "c_custkey", orders_where=C("o_totalprice") > 400000),
    }


@query
def fb_theta_join(spark, d):
    a, b = (load(spark, d, "region").select(C("r_regionkey").alias(n)) for n in ("x", "y"))
    return a.join(b, a["x"] < b["y"])


@query
def fb_full_outer_join(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.join(r, n["n_nationkey"] == r["r_regionkey"] + 3, "full").select(C("n_nationkey").alias("a"), C("r_regionkey").alias("b"))


@query
def fb_multi_join_agg(spark, d):
    o, c, n = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query
def fb_as_of_join(spark, d):
    """Each purchase with the user's latest view at or before it."""
    events = load(spark, d, "events")
    types = F.col("event_type")
    left = events.filter(types == "purchase").select("event_id", "user_id", "ts")
    return joins.as_of(left, events.filter(types == "view").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "seen").select("event_id", "seen")


@query
def fb_range_join(spark, d):
    """Parts by price band of each size; bands are 200 wide."""
    bands = load(spark, d, "nation").select(C("n_nationkey").alias("band"), (C("n_nationkey") * 100.0).alias("low"), (C("n_nationkey") * 100.0 + 200).alias("high"))
    parts = load(spark, d, "part").select("p_partkey", "p_retailprice")
    return joins.in_range(parts, bands, "p_retailprice", "low", "high", 100).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def keys(operation):
    def run(spark, d):
        return operation(load(spark, d, "nation").select(C("n_nationkey").alias("k")), load(spark, d, "region").select(C("r_regionkey").alias("k")))

    return run


@family("fb_union_all", "fb_intersect", "fb_except", "fb_union_distinct", "fb_intersect_all", "fb_except_all")
def set_operations():
    return {"fb_union_all": keys(DataFrame.union), "fb_intersect": keys(DataFrame.intersect), "fb_except": keys(DataFrame.subtract), "fb_union_distinct": keys(lambda a, b: a.union(b).distinct()), "fb_intersect_all": keys(DataFrame.intersectAll), "fb_except_all": keys(DataFrame.exceptAll)}


@query
def fb_order_limit(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(10)


# -- expressions and windows ------------------------------------------------------------------------------------


def projected(table, *columns):
    return lambda spark, d: load(spark, d, table).select(*columns)


@family("fb_case", "fb_unary_minus", "fb_scalar_function", "fb_mixed_width_arith", "fb_json_extract", "fb_array_functions")
def projections():
    return {
        "fb_case": projected("lineitem", *KEYS, F.when(C(Q) > 25, "hi").otherwise("lo").alias("q")),
        "fb_unary_minus": projected("lineitem", *KEYS, (-C(Q)).alias("neg")),
        "fb_scalar_function": projected("orders", "o_orderkey", F.abs("o_totalprice").alias("a"), F.upper("o_orderstatus").alias("u")),
        "fb_mixed_width_arith": projected("lineitem", *KEYS, (C("l_linenumber") * C(Q)).alias("x"), (C("l_linenumber") + C("l_orderkey")).alias("y")),
        "fb_json_extract": projected("events", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
        "fb_array_functions": projected("embeddings", "vec_id", F.size("embedding").alias("n"), C("embedding")[0].alias("first")),
    }


@query
def fb_window_ranking(spark, d):
    by = Window.partitionBy("o_custkey")
    return load(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.rank().over(by.orderBy("o_orderpriority")).alias("rk"), F.dense_rank().over(by.orderBy("o_orderpriority")).alias("dr")
    )


@query
def fb_window_analytic(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice", 2).over(w).alias("nxt"), F.max("o_totalprice").over(w.rowsBetween(-2, 1)).alias("mx"))


@query
def fb_time_bucket(spark, d):
    return tumbling_counts(load(spark, d, "events")).withColumnRenamed("start", "h")


# -- the catalogue ----------------------------------------------------------------------------------------------

MORE_SQL = {
    "agg_salted_sum": "select o_custkey, cast(sum(o_orderkey) as bigint) as s from orders group by o_custkey",
    "fb_as_of_join": "select p.event_id, (select max(v.value) from events v where v.event_type = 'view' and v.user_id = p.user_id and v.ts = (select max(w.ts) from events w where w.event_type = 'view' and w.user_id = p.user_id and w.ts <= p.ts)) as seen from events p where p.event_type = 'purchase'",
    "fb_range_join": "select n_nationkey as band, count(*) as n from part join nation on p_retailprice >= n_nationkey * 100.0 and p_retailprice < n_nationkey * 100.0 + 200 group by n_nationkey",
    "fb_union_distinct": "select n_nationkey as k from nation union select r_regionkey as k from region",
    "fb_intersect_all": "select n_nationkey as k from nation intersect all select r_regionkey as k from region",
    "fb_except_all": "select n_nationkey as k from nation except all select r_regionkey as k from region",
}


def queries() -> dict:
    out = dict(QUERIES)
    for name in NUMBERS:
        out |= {f"arith_{name}": arith(name), f"arith_const_{name}": arith_const(name), f"cmp_col_col_{name}": compare(name, False), f"cmp_col_const_{name}": compare(name, True)}
    return out | {name: as_sql(name) for name in SPARK}


def oracle_sql() -> dict[str, str]:
    made = [{f"arith_{n}": arith_sql(n), f"arith_const_{n}": arith_const_sql(n), f"cmp_col_col_{n}": compare_sql(n, False), f"cmp_col_const_{n}": compare_sql(n, True)} for n in NUMBERS]
    return reduce(lambda a, b: a | b, made, dict(ORACLE)) | MORE_SQL
