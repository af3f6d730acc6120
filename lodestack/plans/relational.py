"""The relational operators applied to the test tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import keyed, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


#: The ordering of line items: their order and line number repeat.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
with e as (select event_id, user_id, epoch_us(ts) as t, value, event_type = 'view' as edge from events),
b as (select *, lead(t) over (partition by user_id order by t, event_id) as nxt from e where edge)
select event_id, user_id, cast(greatest(0, coalesce(nxt, 1706659200000000) - t) as bigint) as span from b
union all select event_id, user_id, cast(0 as bigint) from e where not coalesce(edge, false)
""")
def lookahead_span(spark, sf_dir):
    e = events(spark, sf_dir)
    out = ordered.lookahead_span(e, ["user_id"], "at", ["at", "event_id"], "span", end=F.lit(1706659200000000), boundary=F.col("event_type") == "view")
    return out.select("event_id", "user_id", "span")


@query("""
with e as (select event_id, user_id, epoch_us(ts) as t, cast(floor(value * 1000000) as bigint) as stored from events),
b as (select *, lead(t) over (partition by user_id order by t, event_id) as nxt from e)
select event_id, case when stored % 3 = 0 then greatest(0, coalesce(nxt - t, stored)) else least(greatest(0, coalesce(nxt - t, stored)), stored) end as span from b
""")
def stored_span(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("stored", F.floor(F.col("value") * 1000000))
    return ordered.lookahead_span(e, ["user_id"], "at", ["at", "event_id"], "span", stored=F.col("stored"), placeholder=F.col("stored") % 3 == 0).select("event_id", "span")


@query("""
select event_id, coalesce(last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 0) as filled from events
""")
def forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("filled", F.when(F.col("value") > 50, F.col("value")))
    return ordered.forward_fill(e, ["user_id"], ["ts", "event_id"], {"filled": 0.0}).select("event_id", "filled")


@query("""
with recursive r as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (
  select event_id, user_id, n, case when abs(value) > 25 then value end as emitted, case when abs(value) > 25 then value else 0 end as held from r where n = 1
  union all
  select r.event_id, r.user_id, r.n, case when abs(r.value - f.held) > 25 then r.value end, case when abs(r.value - f.held) > 25 then r.value else f.held end
  from f join r on r.user_id = f.user_id and r.n = f.n + 1
)
select event_id, emitted from f
""")
def tolerance_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return ordered.tolerance_delta(e, ["user_id"], ["ts", "event_id"], "value", 25.0, "emitted").select("event_id", "emitted")


@query("select s_suppkey, unnest(range(s_suppkey % 4)) as repeat from supplier")
def run_length_expand(spark, sf_dir):
    return ordered.run_length_expand(table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4, "repeat").select("s_suppkey", "repeat")


@query("""
with l as (select *, l_returnflag = 'R' as reserved, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  cast(case when reserved then 1 else coalesce(sum(case when reserved then 0 else ceil(l_quantity / 16) * 16 end) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding), 0) end as bigint) as place
from l
""")
def aligned_offset(spark, sf_dir):
    out = ordered.aligned_offset(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE, F.col("l_quantity"), 16, "place", reserved=F.col("l_returnflag") == "R")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "place")


@query("""
with c as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as n from customer)
select c_custkey, p_partkey from c left join part on p_partkey = c_nationkey * 3 + n and (c_nationkey % 5 = 0 or n < c_nationkey % 5)
""")
def positional_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("before", F.col("c_nationkey") * 3).withColumn("number", F.col("c_nationkey") % 5)
    return ordered.positional_join(c, ["c_nationkey"], ["c_custkey"], "before", "number", table(spark, sf_dir, "part"), "p_partkey").select("c_custkey", "p_partkey")


@query("""
with e as (select user_id, epoch_us(ts) as a, epoch_us(ts) + 21600000000 as b from events),
m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when reach is null or a >= reach then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) as island from m)
select user_id, min(a) as a, max(b) as b, count(*) as n_intervals, count(distinct a) as n_restarts from i group by user_id, island
""")
def interval_merge(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.col("at").alias("a"), (F.col("at") + 21600000000).alias("b"))
    return ordered.interval_merge(e, ["user_id"], "a", "b", "restarts").select("user_id", "a", "b", "n_intervals", F.size("restarts").cast("long").alias("n_restarts"))


@query("""
select key, row_number() over (order by m, key) as code from (select lower(event_type) as key, min(event_id) as m from events group by 1) where key <> 'view'
union all select 'view', 0
""")
def first_seen_dictionary(spark, sf_dir):
    return keyed.first_seen_dictionary(table(spark, sf_dir, "events"), F.lower("event_type"), "event_id", root="view")


@query("""
select lower(event_type) as key, count(*) as n_segments, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from events group by 1
""")
def group_segments(spark, sf_dir):
    out = keyed.group_segments(table(spark, sf_dir, "events"), F.lower("event_type"), "event_id", ["value"])
    return out.select("key", F.size("segments").cast("long").alias("n_segments"), F.concat_ws(",", F.expr("transform(segments, x -> cast(x.event_id as string))")).alias("ids"))


@query("""
select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
union all select c_custkey, 'edited ' || c_name, c_acctbal * 2 from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
""")
def replace_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    keys = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    new = c.join(keys, "c_custkey", "left_semi").select("c_custkey", F.concat(F.lit("edited "), "c_name").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return keyed.replace_by_key(c, keys, new, "c_custkey")


@query("""
with k as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as code from nation where n_nationkey % 2 = 1 or n_nationkey < 30)
select s_suppkey, k.code as new_index from supplier join k on s_nationkey = n_nationkey
""")
def mandatory_remap(spark, sf_dir):
    codes = ordered.dense_index(table(spark, sf_dir, "nation"), ["n_nationkey"], "code")
    return keyed.mandatory_remap(table(spark, sf_dir, "supplier"), "s_nationkey", codes, "n_nationkey", "code", "new_index").select("s_suppkey", "new_index")


@query("""
with k as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as code from nation where n_nationkey % 3 <> 0)
select n_regionkey, count(*) as n_children, string_agg(cast(code as varchar), ',' order by n.n_nationkey desc) as children
from nation n join k on k.n_nationkey = n.n_nationkey group by 1
""")
def filter_nested(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    groups = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"))), asc=False).alias("children"))
    codes = ordered.dense_index(n.where("n_nationkey % 3 <> 0"), ["n_nationkey"], "code").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "code")
    out = keyed.filter_nested(groups, "children", "id", codes, "n_nationkey", "code")
    return out.select("n_regionkey", F.col("n_children").cast("long").alias("n_children"), F.concat_ws(",", F.expr("transform(children, x -> cast(x.id as string))")).alias("children"))


@query("""
with gone as (select distinct unnest(range(s_suppkey * 7, s_suppkey * 7 + s_suppkey % 4)) as k from supplier)
select p_partkey, row_number() over (order by p_partkey) - 1 as new_index from part where p_partkey not in (select k from gone)
""")
def reindex_after_delete(spark, sf_dir):
    ranges = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("low"), (F.col("s_suppkey") % 4).alias("n"))
    return ordered.remove_ranges(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", ranges, "low", "n", "new_index").select("p_partkey", "new_index")


@query("""
select l_orderkey, count(*) as n_values, count(*) = count(distinct l_linenumber) and min(l_linenumber) = 1 and max(l_linenumber) = count(*) as contiguous
from lineitem group by 1
""")
def contiguity_check(spark, sf_dir):
    return ordered.contiguity(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@query("""
with o as (
  select c_custkey, case when c_custkey % 10 = 0 then 'Customer#' || cast(c_custkey // 20 as varchar) else c_name end as name from customer where c_custkey % 7 <> 0
  union all select c_custkey + 1000000, upper(c_name) from customer where c_custkey % 50 = 1
)
select lower(name) as key, count(*) as n_rows from o group by 1 having count(*) > 1
""")
def overlay_uniqueness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    edits = c.where("c_custkey % 10 = 0").select("c_custkey", F.expr("'Customer#' || cast(c_custkey div 20 as string)").alias("name"))
    added = c.where("c_custkey % 50 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.upper("name").alias("name"))
    return keyed.duplicates(keyed.overlay(c, edits, c.where("c_custkey % 7 = 0"), added, "c_custkey", "name"), F.lower("name"))


@query("""
select b.o_custkey, b.o_orderkey, min(a.o_orderkey) as earlier_o_orderkey from orders b
join orders a on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
  and not (a.o_orderstatus <> b.o_orderstatus and a.o_orderpriority <> b.o_orderpriority)
group by 1, 2
""")
def conflict_first_owner(spark, sf_dir):
    fields = ["o_orderstatus", "o_orderpriority"]
    apart = (F.col("o_orderstatus") != F.col("earlier_o_orderstatus")) & (F.col("o_orderpriority") != F.col("earlier_o_orderpriority"))
    return keyed.first_conflict(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", apart, fields)


@query("""
select s_suppkey, case when s_nationkey % 6 = 5 then 'missing' when n_regionkey < 3 then 'ok' else 'wrong kind' end as status
from supplier join nation on n_nationkey = s_nationkey
""")
def referential_audit(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5")
    dim = n.select("n_nationkey", F.lit(1).alias("at"), F.when(F.col("n_regionkey") < 3, "composite").otherwise("simple").alias("kind"))
    dim = dim.unionByName(n.select("n_nationkey", F.lit(0).alias("at"), F.lit("overridden").alias("kind")))
    return keyed.referential_audit(table(spark, sf_dir, "supplier"), "s_nationkey", dim, "n_nationkey", "at", "kind", F.lit("composite"), "status").select("s_suppkey", "status")


def _rules():
    return {
        "quantity above 45": ("error", F.col("l_quantity") <= 45),
        "discount above tax": ("warning", F.col("l_discount") <= F.col("l_tax")),
        "open and returned": ("error", ~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"))),
    }


@query("""
select l_orderkey, l_linenumber, l_partkey, 'quantity above 45' as rule, 'error' as severity from lineitem where l_quantity > 45
union all select l_orderkey, l_linenumber, l_partkey, 'discount above tax', 'warning' from lineitem where l_discount > l_tax
union all select l_orderkey, l_linenumber, l_partkey, 'open and returned', 'error' from lineitem where l_linestatus = 'O' and l_returnflag = 'R'
""")
def rule_violations(spark, sf_dir):
    return keyed.rule_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], _rules())


@query("""
select (select count(*) from lineitem where l_quantity > 45 or (l_linestatus = 'O' and l_returnflag = 'R')) = 0 as is_valid,
  (select count(*) from lineitem where l_quantity > 45) + (select count(*) from lineitem where l_linestatus = 'O' and l_returnflag = 'R') as n_errors
""")
def issue_report(spark, sf_dir):
    issues = keyed.rule_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _rules())
    error = F.col("severity") == "error"
    return issues.agg((F.count_if(error) == 0).alias("is_valid"), F.count_if(error).alias("n_errors"))


@query("""
select o_custkey, count(distinct o_orderpriority) as n_distinct, 5 as expected, count(distinct o_orderpriority) = 5 as complete from orders group by 1
""")
def completeness(spark, sf_dir):
    return keyed.completeness(table(spark, sf_dir, "orders"), "o_orderpriority", 5, ["o_custkey"])


@query("""
select c_custkey, min(o_orderkey) as first_match from customer left join orders on o_custkey = c_custkey group by 1
""")
def hash_lookup(spark, sf_dir):
    return keyed.lookup_first(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("select distinct l_suppkey from lineitem order by 1")
def distinct_sorted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().orderBy("l_suppkey")


@query("""
select o_orderkey, case o_orderpriority when '3-MEDIUM' then 0 when '1-URGENT' then 1 when '5-LOW' then 2 else 3 end as rank from orders order by 2, 1
""")
def rank_sort(spark, sf_dir):
    return keyed.rank_sort(table(spark, sf_dir, "orders"), "o_orderpriority", {"3-MEDIUM": 0, "1-URGENT": 1, "5-LOW": 2}, "o_orderkey", 3).select("o_orderkey", "rank")


@query("""
select l_returnflag, count(*) as n_rows, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, count(*) filter (l_linestatus = 'O') as n_open,
  sum(cast(l_quantity as bigint)) / count(*) as ratio from lineitem group by 1
""")
def totals_ratio(spark, sf_dir):
    q = F.sum(F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), q.alias("quantity"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), (q / F.count(F.lit(1))).alias("ratio")
    )


@query("""
with r as (select o_custkey, o_orderkey, sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as running from orders)
select o_custkey, min(o_orderkey) as o_orderkey, cast(min(running) as bigint) as running from r where running > 50000000 group by 1
""")
def budget_first_offender(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return ordered.budget(o, ["o_custkey"], ["o_orderkey"], "cents", 50000000)


@query("""
select a.doc_id, md5(case when a.doc_id % 5 = 0 then '' else coalesce(a.text, '') || case when a.doc_id % 3 = 0 then '!' else '' end end) as before_md5,
  case when a.doc_id % 3 = 0 or (a.doc_id % 5 = 0 and a.text <> '') then a.text end as patch
from documents a
""")
def delta_status(spark, sf_dir):
    after = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = after.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return keyed.delta(before, after, "doc_id", "text")


@query("select doc_id, sha256(coalesce(text, '')) as after_sha from documents")
def delta_apply(spark, sf_dir):
    after = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = after.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return keyed.apply_delta(before, keyed.delta(before, after, "doc_id", "text"), "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("after_sha"))


@query("select event_id, coalesce(case when value > 90 then 'first' end, case when value > 50 then 'second' end, 'third') as found from events")
def first_success(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", keyed.first_success(F.when(v > 90, "first"), F.when(v > 50, "second"), F.lit("third")).alias("found"))


_SIZE = "case when {n} < 1024 then cast({n} as varchar) || ' B' when {n} < 1048576 then printf('%.1f KB', {n} / 1024) when {n} < 1073741824 then printf('%.1f MB', {n} / 1048576) else printf('%.1f GB', {n} / 1073741824) end"


@query(f"select doc_id, {_SIZE.format(n='n_chars')} as size, {_SIZE.format(n='(n_chars * n_chars * 37)')} as larger from documents")
def human_size(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", fx.human_size(n).alias("size"), fx.human_size(n * n * 37).alias("larger"))


@query("select doc_id, upper(md5(coalesce(text, ''))) || chr(13) || chr(10) as tag from documents")
def md5_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.md5_tag(F.coalesce("text", F.lit(""))).alias("tag"))


@query("select page_id, url from pages where lower(url) like '%ref=x'")
def suffix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(fx.suffix_is(F.col("url"), "REF=X")).select("page_id", "url")


@query("select page_id, url from pages where starts_with(url, 'https://')")
def prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select("page_id", "url")


@query(r"""
select page_id, regexp_extract(url, '[^/]*/[^/]*$') as short, regexp_extract(url, '^(.*/)?[^/]*$', 1) || regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') || '_decoded.json' as sibling from pages
""")
def output_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fx.short_path(F.col("url")).alias("short"), fx.sibling_path(F.col("url"), "decoded", "json").alias("sibling"))


@query("""
select page_id, case when page_id % 5 = 0 then 'empty' when page_id % 5 = 1 then 'absolute' when page_id % 5 = 2 then 'drive' when page_id % 5 = 3 then 'parent' end as problem from pages
""")
def path_safety(spark, sf_dir):
    p = F.col("page_id") % 5
    path = F.when(p == 0, "").when(p == 1, F.concat(F.lit("/"), "url")).when(p == 2, F.concat(F.lit("C:"), "url")).when(p == 3, F.concat("url", F.lit("/../x"))).otherwise(F.regexp_replace("url", ":", ""))
    return table(spark, sf_dir, "pages").select("page_id", fx.path_problem(path).alias("problem"))


@query("""
select o_orderkey, (o_orderkey >> 3) & 31 as field, (o_orderkey & ~248) | ((o_custkey & 31) << 3) as replaced,
  case when o_orderkey % 200 < 125 then o_custkey & 7 else o_custkey & 3 end as mode from orders
""")
def bitfield_extract(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fx.bit_field(k, 3, 5).alias("field"), fx.with_bit_field(k, 3, 5, c).alias("replaced"),
        F.when(k % 200 < 125, c.bitwiseAND(7)).otherwise(c.bitwiseAND(3)).alias("mode"),
    )


@query("select p_partkey, p_size / 20.0::double as twips, p_size / 65536.0::double as matrix, p_size / 255.0::double as colour from part")
def fixed_point(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", fx.fixed_point(s, 20.0).alias("twips"), fx.fixed_point(s, 65536.0).alias("matrix"), fx.fixed_point(s, 255.0).alias("colour"))


@query("""
select event_id, cast(round(cos(radians(value)) * 2 * 1000000) as bigint) as a, cast(round(sin(radians(value)) * 2 * 1000000) as bigint) as b,
  cast(round(-sin(radians(value / 2)) * 3 * 1000000) as bigint) as c, cast(round(cos(radians(value / 2)) * 3 * 1000000) as bigint) as d from events
""")
def affine_compose(spark, sf_dir):
    m = fx.affine(F.col("value"), F.col("value") / 2, F.lit(2.0), F.lit(3.0))
    return table(spark, sf_dir, "events").select("event_id", *(F.round(v * 1000000).cast("long").alias(k) for k, v in m.items()))


@query("select event_id, key, value from (select event_id, unnest(json_keys(props)) as key, props from events) t, lateral (select json_extract_string(props, '$.\"' || key || '\"') as value)")
def kv_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("""
select o_orderkey, case when o_custkey >= 0 then o_custkey * 2 else -o_custkey * 2 - 1 end as zigzag, cast(greatest(1, ceil(length(bin(o_orderkey)) / 7.0)) as integer) as n_bytes from orders
""")
def varint_zigzag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.zigzag(F.col("o_custkey")).alias("zigzag"), fx.varint_length(F.col("o_orderkey")).alias("n_bytes"))


@query("""
select event_type as category, row_number() over (order by min(event_id)) - 1 as place from events where event_type like '%ic%' or event_type like '%ew%' group by 1
""")
def command_search(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(fx.matches_query(" IC", F.col("event_type")) | fx.matches_query("ew ", F.lit("x"), F.col("event_type")))
    return keyed.first_seen_dictionary(e, F.col("event_type"), "event_id", name="category", code="place")
