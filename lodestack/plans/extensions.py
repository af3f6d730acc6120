"""Extensions: relational queries that the archive formats do not have, over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import soundbank
from ..operators import ranges
from ..streaming import files as streaming
from .relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def cents(column: str):
    """Money as whole cents, so that sums agree whatever their order."""
    return F.round(F.col(column) * 100).cast("long")


@query("""
select coalesce(l_returnflag, 'all') as returnflag, coalesce(l_linestatus, 'all') as linestatus, count(*) as n_rows, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
from lineitem group by rollup (l_returnflag, l_linestatus)
""")
def rollup_quantity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("linestatus"), "n_rows", "quantity")


@query("""
select o_custkey, o_orderkey, cast(rank as integer) as rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3
""")
def top_orders(spark, sf_dir):
    return ranges.top_each(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""
select c_mktsegment, count(*) as n_orders, cast(sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) as bigint) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where o_orderdate < timestamp '1998-01-01' and l_shipdate > timestamp '1997-01-01' group by 1
""")
def segment_revenue(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    rows = li.where(F.col("l_shipdate") > "1997-01-01").join(o.where(F.col("o_orderdate") < "1998-01-01"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    revenue = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), revenue.alias("revenue"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
select coalesce(s, c) as nation, coalesce(n_suppliers, 0) as n_suppliers, coalesce(n_customers, 0) as n_customers
from (select s_nationkey as s, count(*) as n_suppliers from supplier where s_acctbal < 0 group by 1) full outer join (select c_nationkey as c, count(*) as n_customers from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0 group by 1) on s = c
""")
def full_outer_counts(spark, sf_dir):
    """Suppliers and building customers in debt by nation, whichever of the two a nation has."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    return s.join(c, "nation", "full").fillna(0, ["n_suppliers", "n_customers"])


@query("""
(select p_brand as v from part where p_size > 20 intersect select p_brand from part where p_size <= 20) union all (select p_type from part except select p_type from part where p_retailprice > 1000)
""")
def set_operations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    both = p.where("p_size > 20").select(F.col("p_brand").alias("v")).intersect(p.where("p_size <= 20").select("p_brand"))
    return both.unionByName(p.select(F.col("p_type").alias("v")).subtract(p.where("p_retailprice > 1000").select("p_type")))


@query("""
with a as (select event_id, user_id, ts from events where event_type = 'purchase'),
b as (select user_id, ts, event_id as last_event_id, value as last_value from (select *, row_number() over (partition by user_id, ts order by event_id desc) as r from events where event_type = 'view') where r = 1)
select a.event_id, a.user_id, last_event_id, last_value from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts
""")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return ranges.as_of(bought, seen, ["user_id"], "ts", ["event_id", "value"], "event_id").select("event_id", "user_id", "last_event_id", "last_value")


@query("""
select p_partkey, s_suppkey from part join supplier on p_retailprice >= 900 + s_suppkey * 3 and p_retailprice < 900 + s_suppkey * 3 + s_suppkey % 7
""")
def range_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(900.0) + F.col("s_suppkey") * 3).alias("low")).withColumn("high", F.col("low") + F.col("s_suppkey") % 7)
    return ranges.range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", s, "low", "high", 5.0).select("p_partkey", "s_suppkey")


@query("""
select time_bucket(interval 6 hours, ts) as start, event_type, count(*) as n from events group by 1, 2
""")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(e, "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from l)
select user_id, min(ts) as start, count(*) as n from s group by user_id, session
""")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e, "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
select o_orderkey, case when o_orderkey & 1 = 0 then 'global' else 'game_object' end as scope,
  case (o_orderkey >> 1) & (case when o_custkey % 200 < 125 then 7 else 3 end) when 1 then 'one' when 2 then 'all' when 4 then 'all_except' else 'none' end as mode
from orders
""")
def event_action_bits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    packed, version = F.col("o_orderkey").bitwiseAND(0xFF), F.col("o_custkey") % 200
    return o.select("o_orderkey", soundbank.action_scope(packed).alias("scope"), soundbank.action_mode(packed, version).alias("mode"))
