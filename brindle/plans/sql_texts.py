"""SQL of the catalogue: for DuckDB, and for Spark where a query is clearer as text than as DataFrame calls."""

from __future__ import annotations

#: DuckDB text of each query that :mod:`brindle.plans.catalog` doesn't generate.
ORACLE = {
    "scan_full_row": "select * from region",
    "scan_passthrough_types": "select l_orderkey, cast(l_linenumber as smallint) as c_int2, l_linenumber as c_int4, l_partkey as c_int8, cast(l_discount as float) as c_float4, l_quantity as c_float8, l_linenumber > 3 as c_bool, l_returnflag as c_text, cast(l_shipdate as date) as c_date, l_shipdate as c_timestamp from lineitem",
    "project_column": "select l_quantity from lineitem",
    "project_computed": "select l_orderkey, l_linenumber, l_quantity + 1 as quantity_plus_one from lineitem",
    "project_q1_exprs": "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as disc_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem",
    "filter_single": "select l_orderkey, l_linenumber from lineitem where l_quantity < 10",
    "filter_conjunction": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity <= 20 and l_discount > 0.05",
    "filter_bool_column": "select l_orderkey, l_linenumber from (select *, l_linenumber > 3 as flag from lineitem) t where flag",
    "filter_null_is_not_true": "select l_orderkey, l_linenumber from (select *, nullif(l_linenumber, 3) as n from lineitem) t where n <= 4",
    "filter_empty_result": "select l_orderkey from lineitem where l_quantity < 0",
    "date_le_date": "select l_orderkey, l_linenumber from lineitem where cast(l_shipdate as date) <= date '1998-08-17'",
    "date_le_timestamp": "select l_orderkey, l_linenumber from lineitem where cast(l_shipdate as date) <= timestamp '1998-08-17 12:00:00'",
    "date_minus_interval": "select o_orderkey, cast(o_orderdate as date) - interval 106 day as d106, cast(o_orderdate as date) - interval 1 month as m1 from orders",
    "timestamp_plus_interval": "select event_id, ts + interval 1 month as m, ts + interval 2 day as d, ts + interval 90 minute as t from events",
    "timestamp_minus_interval": "select event_id, ts - interval 1 month as m, ts - interval 2 day as d, ts - interval 90 minute as t from events",
    "timestamp_cmp_sign": "select event_id, case when ts < timestamp '2024-01-15' then -1 when ts > timestamp '2024-01-15' then 1 else 0 end as c from events",
    "agg_plain_count": "select count(l_discount) as n from lineitem",
    "agg_plain_count_star": "select count(*) as n from lineitem",
    "agg_plain_sum_int4": "select cast(sum(l_linenumber) as bigint) as s from lineitem",
    "agg_plain_sum_float8": "select sum(l_quantity) as s from lineitem",
    "agg_plain_avg_float8": "select avg(l_quantity) as a from lineitem",
    "agg_plain_empty_input": "select count(l_quantity) as n, sum(l_quantity) as s, avg(l_quantity) as a from lineitem where l_quantity < 0",
    "agg_hash_empty_input": "select l_returnflag, count(l_quantity) as n from lineitem where l_quantity < 0 group by l_returnflag",
    "agg_group_single_key": "select l_linenumber, count(l_quantity) as n, cast(sum(l_linenumber) as bigint) as si, sum(l_quantity) as sd, avg(l_quantity) as ad from lineitem group by l_linenumber",
    "agg_group_multi_key": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, avg(l_quantity) as avg_qty from lineitem group by l_returnflag, l_linestatus",
    "agg_group_filtered": "select l_linenumber, sum(l_quantity) as s, avg(l_quantity) as a from lineitem where l_linenumber < 3 group by l_linenumber",
    "agg_group_key_date": "select cast(o_orderdate as date) as d, count(o_orderkey) as n from orders group by cast(o_orderdate as date)",
    "agg_group_key_null": "select nullif(l_linenumber, 3) as k, count(l_quantity) as n from lineitem group by nullif(l_linenumber, 3)",
    "agg_null_inputs": "select l_returnflag, count(nullif(l_linenumber, 3)) as n, cast(sum(nullif(l_linenumber, 3)) as bigint) as si, avg(nullif(l_quantity, 10)) as a from lineitem group by l_returnflag",
    "agg_high_cardinality": "select l_orderkey, count(l_quantity) as n, sum(l_quantity) as s from lineitem group by l_orderkey",
    "agg_computed_argument": "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as disc_price from lineitem group by l_returnflag",
    "agg_shared_state": "select l_linenumber, avg(l_quantity) as a1, avg(l_quantity) as a2, sum(l_quantity) as s from lineitem group by l_linenumber",
    "distinct_single": "select distinct l_returnflag from lineitem",
    "distinct_multi": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem where l_quantity > 40",
    "group_no_aggregate": "select l_linenumber from lineitem group by l_linenumber",
    "tpch_q1": "with priced as (select *, l_extendedprice * (1 - l_discount) as net from lineitem where cast(l_shipdate as date) <= date '1998-12-01' - interval 106 day) select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(net), 2) as sum_disc_price, round(sum(net * (1 + l_tax)), 2) as sum_charge, avg(l_quantity) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(l_discount) as count_order from priced group by l_returnflag, l_linestatus",
    "agg_count_distinct": "select l_returnflag, count(distinct l_partkey) as n from lineitem group by l_returnflag",
    "agg_distinct_multi_input": "select l_returnflag, count(distinct (l_partkey, l_suppkey)) as n from lineitem group by l_returnflag",
    "agg_ordered_input": "select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_quantity, l_linenumber) as ks from lineitem group by l_orderkey",
    "agg_filter_clause": "select l_returnflag, count(l_quantity) filter (where l_linenumber < 3) as n, sum(l_quantity) filter (where l_linenumber < 3) as s from lineitem group by l_returnflag",
    "agg_having": "select l_linenumber, sum(l_quantity) as s from lineitem group by l_linenumber having sum(l_quantity) > 217500",
    "agg_rollup": "select l_returnflag, l_linestatus, sum(l_quantity) as s from lineitem group by rollup (l_returnflag, l_linestatus)",
    "agg_cube": "select l_returnflag, l_linestatus, count(l_quantity) as n, cast(grouping(l_returnflag) as int) as g1 from lineitem group by cube (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "select l_returnflag, l_linestatus, l_linenumber, count(l_quantity) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())",
    "agg_over_sorted_input": "select l_orderkey, sum(l_quantity) as s from (select * from lineitem order by l_orderkey) t group by l_orderkey",
    "agg_min_max": "select l_returnflag, min(l_quantity) as mn, max(l_shipdate) as mx from lineitem group by l_returnflag",
    "agg_ordered_set": "select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as med from lineitem group by l_returnflag",
    "agg_window": "select o_orderkey, cast(sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as bigint) as r from orders",
    "fb_inner_join": "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey",
    "fb_left_join": "select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey",
    "fb_semi_join": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "fb_anti_join": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)",
    "fb_theta_join": "select a.r_regionkey as x, b.r_regionkey as y from region a join region b on a.r_regionkey < b.r_regionkey",
    "fb_order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "fb_union_all": "select n_nationkey as k from nation union all select r_regionkey as k from region",
    "fb_intersect": "select n_nationkey as k from nation intersect select r_regionkey as k from region",
    "fb_except": "select n_nationkey as k from nation except select r_regionkey as k from region",
    "fb_or_not": "select l_orderkey, l_linenumber from lineitem where l_quantity < 5 or not (l_discount < 0.09)",
    "fb_is_null": "select l_orderkey, l_linenumber from (select *, nullif(l_linenumber, 3) as n from lineitem) t where n is null",
    "fb_in_list": "select l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 3)",
    "fb_case": "select l_orderkey, l_linenumber, case when l_quantity > 25 then 'hi' else 'lo' end as q from lineitem",
    "fb_text_predicate": "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'",
    "fb_unary_minus": "select l_orderkey, l_linenumber, -l_quantity as neg from lineitem",
    "fb_scalar_function": "select o_orderkey, abs(o_totalprice) as a, upper(o_orderstatus) as u from orders",
    "fb_const_on_left_cmp": "select l_orderkey, l_linenumber from lineitem where 5 > l_linenumber",
    "fb_mixed_width_arith": "select l_orderkey, l_linenumber, l_linenumber * l_quantity as x, l_linenumber + l_orderkey as y from lineitem",
    "fb_scalar_subquery": "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)",
    "fb_cte": "with t as (select l_orderkey, l_quantity from lineitem where l_linenumber = 1) select count(l_quantity) as n from t",
    "fb_window_ranking": "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as rn, cast(rank() over (partition by o_custkey order by o_orderpriority) as integer) as rk, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as integer) as dr from orders",
    "fb_window_analytic": "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev, lead(o_totalprice, 2) over (partition by o_custkey order by o_orderkey) as nxt, max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as mx from orders",
    "fb_string_functions": "select c_custkey, upper(c_name) as u, cast(length(c_name) as integer) as n, substring(c_name, 1, 3) as s3, concat(c_mktsegment, '-', cast(c_nationkey as varchar)) as k from customer where c_name like 'C%'",
    "fb_math_functions": "select s_suppkey, abs(s_acctbal) as a, cast(floor(s_acctbal) as bigint) as f, cast(ceil(s_acctbal) as bigint) as c, sqrt(abs(s_acctbal)) as r from supplier",
    "fb_json_extract": "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events",
    "fb_array_functions": "select vec_id, cast(len(embedding) as integer) as n, embedding[1] as first from embeddings",
    "fb_time_bucket": "select date_trunc('hour', ts) as h, event_type, count(*) as n from events group by all",
    "fb_multi_join_agg": "select n.n_name, count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by n.n_name",
    "fb_full_outer_join": "select n.n_nationkey as a, r.r_regionkey as b from nation n full outer join region r on n.n_nationkey = r.r_regionkey + 3",
    "fb_correlated_subquery": "select o_orderkey from orders o where o_totalprice > (select avg(i.o_totalprice) * 1.5 from orders i where i.o_custkey = o.o_custkey)",
}

#: (tables, text) of the queries that run as Spark SQL.
SPARK = {
    "agg_ordered_input": (["lineitem"], "select l_orderkey, array_join(transform(array_sort(collect_list(struct(l_quantity, l_linenumber))), x -> cast(x.l_linenumber as string)), ',') as ks from lineitem group by l_orderkey"),
    "agg_ordered_set": (("lineitem",), "select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as med from lineitem group by l_returnflag"),
    "fb_scalar_subquery": (("orders",), "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)"),
    "fb_cte": (("lineitem",), "with t as (select l_orderkey, l_quantity from lineitem where l_linenumber = 1) select count(l_quantity) as n from t"),
    "fb_correlated_subquery": (("orders",), "select o_orderkey from orders o where o_totalprice > (select avg(i.o_totalprice) * 1.5 from orders i where i.o_custkey = o.o_custkey)"),
    "agg_over_sorted_input": (("lineitem",), "select l_orderkey, sum(l_quantity) as s from (select * from lineitem order by l_orderkey) t group by l_orderkey"),
    "agg_grouping_sets": (("lineitem",), "select l_returnflag, l_linestatus, l_linenumber, count(l_quantity) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())"),
    "agg_distinct_multi_input": (("lineitem",), "select l_returnflag, count(distinct l_partkey, l_suppkey) as n from lineitem group by l_returnflag"),
    "fb_string_functions": (["customer"], "select c_custkey, upper(c_name) as u, length(c_name) as n, substring(c_name, 1, 3) as s3, concat(c_mktsegment, '-', cast(c_nationkey as string)) as k from customer where c_name like 'C%'"),
    "fb_math_functions": (("supplier",), "select s_suppkey, abs(s_acctbal) as a, floor(s_acctbal) as f, ceil(s_acctbal) as c, sqrt(abs(s_acctbal)) as r from supplier"),
}
