"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import write
from .model import service

#: name -> (set, options, SQL)
SIMPLE: dict[str, tuple[str, dict[str, str], str]] = {}


def _add(name: str, set_name: str, sql: str, **options: str) -> None:
    SIMPLE[name] = (set_name, {f"${k}": v for k, v in options.items()}, sql)


def _filter(name: str, set_name: str, table: str, odata: str, sql: str, select: str | None = None) -> None:
    more = {"select": select} if select else {}
    _add(name, set_name, f"select {select or '*'} from {table} where {sql}", filter=odata, **more)


_add("scan_top", "Regions", "select r_regionkey, r_name from region", orderby="r_regionkey")
_filter("filter_eq_str", "Orders", "orders", "o_orderstatus eq 'F'", "o_orderstatus='F'")
_filter("filter_ne", "Customers", "customer", "c_mktsegment ne 'BUILDING'", "c_mktsegment<>'BUILDING'")
_filter("filter_range_and", "Orders", "orders", "o_totalprice ge 1000 and o_totalprice lt 50000", "o_totalprice>=1000 and o_totalprice<50000")
_filter("filter_or_paren", "Parts", "part", "(p_size gt 40 or p_size le 3) and p_brand eq 'Brand#2'", "(p_size>40 or p_size<=3) and p_brand='Brand#2'")
_filter("filter_not", "Parts", "part", "not (p_size gt 10)", "not (p_size>10)")
_filter("filter_prec", "Parts", "part", "p_size gt 45 or p_size lt 3 and p_brand eq 'Brand#1'", "p_size>45 or (p_size<3 and p_brand='Brand#1')")
_filter("filter_col_col", "LineItems", "lineitem", "l_tax gt l_discount", "l_tax>l_discount")
_filter("filter_in", "Orders", "orders", "o_orderstatus in ('F','P')", "o_orderstatus in ('F','P')")
_filter("filter_bool_literal", "Regions", "region", "true", "true")
_filter("filter_date_lit", "Orders", "orders", "o_orderdate ge 1998-01-01", "o_orderdate>=timestamp '1998-01-01'")
_filter("filter_dto_lit", "Events", "events", "ts lt 2024-01-02T00:00:00Z", "ts<timestamp '2024-01-02'")
_filter("arith_add", "LineItems", "lineitem", "l_quantity add 10 gt 55", "l_quantity+10>55")
_filter("arith_sub", "Orders", "orders", "o_totalprice sub 1000 lt 1000", "o_totalprice-1000<1000")
_filter("arith_mul", "Parts", "part", "p_size mul 2 ge 90", "p_size*2>=90")
_filter("arith_div_int", "Parts", "part", "p_size div 10 eq 3", "p_size//10=3")
_filter("arith_divby", "Parts", "part", "p_size divby 10 eq 3.5", "p_size/10=3.5")
_filter("arith_mod", "Orders", "orders", "o_orderkey mod 7 eq 0", "o_orderkey%7=0")
_filter("arith_neg", "Customers", "customer", "c_acctbal lt -100", "c_acctbal<-100")
_filter("arith_neg_property", "Customers", "customer", "-c_acctbal gt 100", "-c_acctbal>100")
_filter("str_contains", "Parts", "part", "contains(p_name,'ring')", "contains(p_name,'ring')")
_filter("str_startswith", "Parts", "part", "startswith(p_name,'small')", "starts_with(p_name,'small')")
_filter("str_endswith", "Parts", "part", "endswith(p_name,'ring')", "ends_with(p_name,'ring')")
_filter("str_wildcard_literal", "Documents", "documents", "contains(text,'%')", "contains(text,'%')", "doc_id")
_filter("str_tolower", "Customers", "customer", "tolower(c_mktsegment) eq 'machinery'", "lower(c_mktsegment)='machinery'")
_filter("str_toupper", "Parts", "part", "startswith(toupper(p_name),'SMALL')", "starts_with(upper(p_name),'SMALL')")
_filter("str_trim_length", "Parts", "part", "length(trim(p_name)) gt 11", "length(trim(p_name))>11")
_filter("str_indexof", "Parts", "part", "indexof(p_name,'ring') ge 0", "instr(p_name,'ring')-1>=0")
_filter("str_substring2", "Parts", "part", "substring(p_brand,6) eq '2'", "substr(p_brand,7)='2'")
_filter("str_substring3", "Parts", "part", "substring(p_name,0,5) eq 'small'", "substr(p_name,1,5)='small'")
_filter("str_concat", "Parts", "part", "concat(concat(p_brand,'|'),p_type) eq 'Brand#2|ECONOMY'", "p_brand||'|'||p_type='Brand#2|ECONOMY'")
_filter("str_matches_pattern", "Parts", "part", "matchesPattern(p_name,'^s.*g$')", "regexp_matches(p_name,'^s.*g$')")
_filter("date_year_month", "Orders", "orders", "year(o_orderdate) eq 1995 and month(o_orderdate) gt 9", "year(o_orderdate)=1995 and month(o_orderdate)>9")
_filter("date_day", "Orders", "orders", "day(o_orderdate) eq 15", "day(o_orderdate)=15")
_filter("date_date", "Events", "events", "date(ts) eq 2024-01-02", "cast(ts as date)=date '2024-01-02'")
_filter("date_hour_minute_second", "Events", "events", "hour(ts) eq 3 and minute(ts) lt 30 and second(ts) ge 10", "hour(ts)=3 and minute(ts)<30 and second(ts)>=10")
_filter("math_floor_ceiling", "Events", "events", "floor(value) eq 10 or ceiling(value) eq 20", "floor(value)=10 or ceil(value)=20")
_add("nav_path1", "Orders", "select o.* from orders o join customer c on c.c_custkey=o.o_custkey where c_mktsegment='BUILDING'", filter="customer/c_mktsegment eq 'BUILDING'")
_add("nav_path3", "Orders", "select o.* from orders o join customer c on c.c_custkey=o.o_custkey join nation n on n.n_nationkey=c.c_nationkey join region r on r.r_regionkey=n.n_regionkey where r.r_name='ASIA'", filter="customer/nation/region/r_name eq 'ASIA'")
_add("nav_path_in_or", "Orders", "select o.* from orders o join customer c on c.c_custkey=o.o_custkey where starts_with(c_mktsegment,'AUTO') or o_totalprice>400000", filter="startswith(customer/c_mktsegment,'AUTO') or o_totalprice gt 400000")
_add("nav_it_path", "Orders", "select o.* from orders o join customer c on c.c_custkey=o.o_custkey where c_acctbal>5000", filter="$it/customer/c_acctbal gt 5000")
_add("filter_eq_null", "Documents", "select d.doc_id,d.lang,d.source,d.n_chars from documents d where (select quality from labels l where l.doc_id=d.doc_id) is null", filter="label/quality eq null", select="doc_id,lang,source,n_chars")
_add("filter_ne_null", "Documents", "select d.doc_id,d.lang,d.source,d.n_chars from documents d where (select quality from labels l where l.doc_id=d.doc_id) is not null", filter="label/quality ne null", select="doc_id,lang,source,n_chars")
_ITEMS = "select {} from lineitem l where l.l_orderkey=o.o_orderkey"
_filter("any_1n", "Orders", "orders o", "items/any(i:i/l_quantity gt 40)", f"exists({_ITEMS.format(1)} and l.l_quantity>40)")
_filter("any_empty", "Orders", "orders o", "items/any()", f"exists({_ITEMS.format(1)})")
_filter("all_1n", "Orders", "orders o", "items/all(i:i/l_quantity gt 5)", f"not exists({_ITEMS.format(1)} and not(l.l_quantity>5))")
_filter("all_empty", "Regions", "region", "nations/all()", "true")
_filter("any_or", "Orders", "orders o", "o_orderstatus eq 'F' or items/any(i:i/l_quantity gt 40)", f"o_orderstatus='F' or exists({_ITEMS.format(1)} and l.l_quantity>40)")
_filter("not_any", "Orders", "orders o", "not items/any(i:i/l_returnflag eq 'R')", f"not exists({_ITEMS.format(1)} and l.l_returnflag='R')")
_filter("any_it_outer", "Orders", "orders o", "items/any(i:i/l_extendedprice gt $it/o_totalprice)", f"exists({_ITEMS.format(1)} and l.l_extendedprice>o.o_totalprice)")
_filter("any_nav_inside", "Orders", "orders o", "items/any(i:i/part/p_size gt 49)", "exists(select 1 from lineitem l join part p on p.p_partkey=l.l_partkey where l.l_orderkey=o.o_orderkey and p.p_size>49)")
_add("any_outer_nav", "Orders", "select o.* from orders o join customer c on c.c_custkey=o.o_custkey where exists(select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l.l_quantity>45 and c.c_mktsegment='BUILDING')", filter="items/any(i:i/l_quantity gt 45 and customer/c_mktsegment eq 'BUILDING')")
_filter("any_nested", "Customers", "customer c", "orders/any(o:o/items/any(i:i/l_quantity gt 49))", "exists(select 1 from orders o where o.o_custkey=c.c_custkey and exists(select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l.l_quantity>49))")
_filter("any_mn", "Parts", "part p", "suppliers/any(s:s/s_acctbal gt 9000)", "exists(select 1 from lineitem j join supplier s on s.s_suppkey=j.l_suppkey where j.l_partkey=p.p_partkey and s.s_acctbal>9000)")
_filter("all_mn", "Parts", "part p", "suppliers/all(s:s/s_acctbal gt 0)", "not exists(select 1 from lineitem j join supplier s on s.s_suppkey=j.l_suppkey where j.l_partkey=p.p_partkey and not(s.s_acctbal>0))")
_add("select_key", "Customers", "select c_name, c_custkey from customer", select="c_name")
_add("order_top_skip", "Orders", "select * from orders order by o_totalprice desc,o_orderkey limit 10 offset 5", orderby="o_totalprice desc,o_orderkey", top="10", skip="5")
_add("order_expression", "Parts", "select * from part order by length(p_name) desc nulls last,p_size*2 nulls first,p_partkey limit 20", orderby="length(p_name) desc,p_size mul 2", top="20")
_add("top_zero", "Orders", "select * from orders limit 0", top="0")
_add("search_terms", "Documents", "select doc_id from documents where not contains(lower(text),'the')", search="NOT the", select="doc_id")
_add("search_phrase_and", "Parts", "select * from part where contains(lower(p_name),'small') and contains(lower(p_name),'ring')", search='"small" ring')
_add("search_bool", "Customers", "select * from customer where contains(lower(c_name),'building') or contains(lower(c_mktsegment),'building') or contains(lower(c_name),'machinery') or contains(lower(c_mktsegment),'machinery')", search="BUILDING OR MACHINERY")
_add("apply_agg_global", "Orders", "select max(o_totalprice) mx,count(*) n from orders", apply="aggregate(o_totalprice with max as mx,$count as n)")
_add("apply_filter_groupby", "Orders", "select o_orderpriority,count(*) n from orders where o_orderstatus='F' group by 1", apply="filter(o_orderstatus eq 'F')/groupby((o_orderpriority),aggregate($count as n))")
_add("apply_groupby_distinct", "Orders", "select distinct o_orderstatus,o_orderpriority from orders", apply="groupby((o_orderstatus,o_orderpriority))")
_add("apply_two_steps", "Orders", "select max(n) mx,count(*) groups from (select o_custkey,count(*) n from orders group by 1)", apply="groupby((o_custkey),aggregate($count as n))/aggregate(n with max as mx,$count as groups)")
_add("apply_filter_lambda", "Orders", "select o_orderstatus,count(*) n from orders o where exists(select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l.l_quantity>45) group by 1", apply="filter(items/any(i:i/l_quantity gt 45))/groupby((o_orderstatus),aggregate($count as n))")

Query = Callable[[SparkSession, str], DataFrame]


def _simple(set_name: str, options: dict[str, str]) -> Query:
    return lambda spark, folder: service(spark, folder).query(set_name, options)


def apply_groupby(spark, folder):
    df = service(spark, folder).query("LineItems", {"$apply": "groupby((l_returnflag,l_linestatus),aggregate($count as n,l_quantity with sum as q,l_quantity with avg as a,l_quantity with min as mn,l_quantity with max as mx,l_suppkey with countdistinct as ds,l_tax with count as c))"})
    return df.withColumn("a", F.round("a", 6))


def count_path(spark, folder):
    return service(spark, folder).count("Orders", {"$filter": "o_orderstatus eq 'O'"})


def entity_by_key(spark, folder):
    return service(spark, folder).by_key("Orders", 7)


def etag(spark, folder):
    return service(spark, folder).etags("Orders")


def _flat(df: DataFrame, nav: str, **columns: str) -> DataFrame:
    """Nested rows as rows, so that they can be compared with SQL."""
    df = df.select("*", F.explode_outer(nav).alias("__x"))
    return df.select(*[F.col(v.replace("@", "__x.")).alias(k) for k, v in columns.items()])


def expand_n1(spark, folder):
    return service(spark, folder).query("Orders", {"$expand": "customer($select=c_name)"}).select("o_orderkey", "customer.c_custkey", "customer.c_name")


def expand_1n_filter(spark, folder):
    return _flat(service(spark, folder).query("Orders", {"$expand": "items($filter=l_quantity gt 45)"}), "items", o_orderkey="o_orderkey", l_linenumber="@l_linenumber", l_quantity="@l_quantity")


def expand_1n_top(spark, folder):
    return _flat(service(spark, folder).query("Customers", {"$expand": "orders($orderby=o_totalprice desc;$top=2;$skip=1)"}), "orders", c_custkey="c_custkey", o_orderkey="@o_orderkey", o_totalprice="@o_totalprice")


def expand_mn(spark, folder):
    return _flat(service(spark, folder).query("Parts", {"$expand": "suppliers"}), "suppliers", p_partkey="p_partkey", s_suppkey="@s_suppkey")


def expand_nested(spark, folder):
    df = service(spark, folder).query("Regions", {"$expand": "nations($expand=customers($filter=c_acctbal gt 9000))"})
    df = df.select("r_regionkey", F.explode_outer("nations").alias("n")).select("r_regionkey", "n.n_nationkey", F.explode_outer("n.customers").alias("c"))
    return df.select("r_regionkey", "n_nationkey", "c.c_custkey")


def expand_page(spark, folder):
    options = {"$top": "7", "$skip": "3", "$orderby": "c_acctbal desc", "$expand": "orders($orderby=o_totalprice desc;$top=2)"}
    return _flat(service(spark, folder).query("Customers", options), "orders", c_custkey="c_custkey", o_orderkey="@o_orderkey", o_totalprice="@o_totalprice")


def expand_page_mn(spark, folder):
    options = {"$top": "9", "$orderby": "p_retailprice desc", "$expand": "suppliers($orderby=s_acctbal desc;$top=2;$skip=1)"}
    return _flat(service(spark, folder).query("Parts", options), "suppliers", p_partkey="p_partkey", s_suppkey="@s_suppkey")


def expand_page_nested(spark, folder):
    df = service(spark, folder).query("Nations", {"$top": "3", "$expand": "customers($top=2;$expand=orders($filter=o_orderstatus eq 'F'))"})
    df = df.select("n_nationkey", F.explode_outer("customers").alias("c")).select("n_nationkey", "c.c_custkey", F.explode_outer("c.orders").alias("o"))
    return df.select("n_nationkey", "c_custkey", "o.o_orderkey")


def expand_count(spark, folder):
    return service(spark, folder).query("Orders", {"$expand": "items/$count($filter=l_quantity gt 40)"}).select("o_orderkey", F.col("`items@odata.count`").alias("items_count"))


def expand_search(spark, folder):
    return _flat(service(spark, folder).query("Nations", {"$expand": "customers($search=BUILDING)"}), "customers", n_nationkey="n_nationkey", c_custkey="@c_custkey")


def expand_levels(spark, folder):
    df = service(spark, folder).query("Conversations", {"$expand": "previous($levels=2)"})
    return df.select("conv_id", "turn", F.col("previous.turn").alias("t1"), F.col("previous.previous.turn").alias("t2"))


def _scoped(type_name: str, condition: str):
    def change(specs):
        specs[type_name] = replace(specs[type_name], scope=lambda df, ctx: df.where(condition))

    return change


def scope_root(spark, folder):
    return service(spark, folder, _scoped("Order", "o_orderpriority = '1-URGENT'")).query("Orders")


def scope_lambda(spark, folder):
    return service(spark, folder, _scoped("Order", "o_orderstatus = 'F'")).query("Customers", {"$filter": "orders/all(o:o/o_totalprice gt 50000)"})


def scope_navigation(spark, folder):
    return service(spark, folder, _scoped("Customer", "c_acctbal > 0")).query("Orders", {"$filter": "customer/c_name eq null", "$select": "o_orderkey"})


def crud_snapshot(spark, folder):
    registry = service(spark, folder).registry
    spec = registry.spec("Customers")
    registry.overlay["Customers"] = write.updated(registry, spec, {"c_custkey": 7}, {"c_acctbal": 0.0}, False)
    return write.deleted(registry, spec, {"c_custkey": 8})


def service_document(spark, folder):
    from . import metadata

    rows = metadata.service_document(service(spark, folder).registry)["value"]
    return spark.createDataFrame([(r["name"], r["url"], r["kind"]) for r in rows], "name string, url string, kind string")


#: query -> SQL
SHAPED = {
    apply_groupby: "select l_returnflag,l_linestatus,count(*) n,cast(sum(cast(l_quantity as decimal(12,2))) as double) q,round(avg(l_quantity),6) a,min(l_quantity) mn,max(l_quantity) mx,count(distinct l_suppkey) ds,count(l_tax) c from lineitem group by 1,2",
    count_path: "select count(*) as cnt from orders where o_orderstatus='O'",
    entity_by_key: "select * from orders where o_orderkey=7",
    etag: "select o_orderkey,'W/\"'||to_base64(encode(strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.%gZ')))||'\"' as etag from orders",
    expand_n1: "select o.o_orderkey,c.c_custkey,c.c_name from orders o left join customer c on c.c_custkey=o.o_custkey",
    expand_1n_filter: "select o.o_orderkey,l.l_linenumber,l.l_quantity from orders o left join lineitem l on l.l_orderkey=o.o_orderkey and l.l_quantity>45",
    expand_1n_top: "select c.c_custkey,o.o_orderkey,o.o_totalprice from customer c left join (select *,row_number() over(partition by o_custkey order by o_totalprice desc,o_orderkey) rn from orders) o on o.o_custkey=c.c_custkey and rn>1 and rn<=3",
    expand_mn: "select p.p_partkey,s.s_suppkey from part p left join (select distinct l_partkey,l_suppkey from lineitem) j on j.l_partkey=p.p_partkey left join supplier s on s.s_suppkey=j.l_suppkey",
    expand_nested: "select r.r_regionkey,n.n_nationkey,c.c_custkey from region r left join nation n on n.n_regionkey=r.r_regionkey left join customer c on c.c_nationkey=n.n_nationkey and c.c_acctbal>9000",
    expand_page: "select c.c_custkey,o.o_orderkey,o.o_totalprice from (select * from customer order by c_acctbal desc,c_custkey limit 7 offset 3) c left join (select *,row_number() over(partition by o_custkey order by o_totalprice desc,o_orderkey) rn from orders) o on o.o_custkey=c.c_custkey and rn<=2",
    expand_page_mn: "select p.p_partkey,s.s_suppkey from (select * from part order by p_retailprice desc,p_partkey limit 9) p left join (select j.l_partkey,s_suppkey,row_number() over(partition by j.l_partkey order by s_acctbal desc,s_suppkey) rn from (select distinct l_partkey,l_suppkey from lineitem) j join supplier on s_suppkey=j.l_suppkey) s on s.l_partkey=p.p_partkey and rn between 2 and 3",
    expand_page_nested: "select n.n_nationkey,c.c_custkey,o.o_orderkey from (select * from nation order by n_nationkey limit 3) n left join (select *,row_number() over(partition by c_nationkey order by c_custkey) rn from customer) c on c.c_nationkey=n.n_nationkey and rn<=2 left join orders o on o.o_custkey=c.c_custkey and o_orderstatus='F'",
    expand_count: "select o.o_orderkey,count(l.l_orderkey) as items_count from orders o left join lineitem l on l.l_orderkey=o.o_orderkey and l.l_quantity>40 group by 1",
    expand_search: "select n.n_nationkey,c.c_custkey from nation n left join customer c on c.c_nationkey=n.n_nationkey and (contains(lower(c_name),'building') or contains(lower(c_mktsegment),'building'))",
    expand_levels: "select a.conv_id,a.turn,b.turn t1,c.turn t2 from conversations a left join conversations b on b.conv_id=a.conv_id and b.turn=a.turn-1 left join conversations c on c.conv_id=b.conv_id and c.turn=b.turn-1",
    scope_root: "select * from orders where o_orderkey in (select o_orderkey from orders where o_orderpriority='1-URGENT')",
    scope_lambda: "select * from customer c where not exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderstatus='F' and not(o.o_totalprice>50000))",
    scope_navigation: "select o_orderkey from orders o left join customer c on c.c_custkey=o.o_custkey and c.c_acctbal>0 where c.c_name is null",
    crud_snapshot: "select c_custkey,c_name,c_nationkey,case when c_custkey=7 then 0.0::double else c_acctbal end as c_acctbal,c_mktsegment from customer where c_custkey<>8",
    service_document: "select * from (values " + ",".join(f"('{n}','{n}','EntitySet')" for n in "Regions Nations Customers Orders LineItems Parts Suppliers Documents Labels Conversations Events Pages Benchmark Embeddings".split()) + ") t(name,url,kind)",
}


def queries() -> dict[str, Query]:
    return {name: _simple(s, o) for name, (s, o, _) in SIMPLE.items()} | {f.__name__: f for f in SHAPED}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in SIMPLE.items()} | {f.__name__: sql for f, sql in SHAPED.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return service(spark, folder).query("Orders", {"$filter": "o_totalprice gt 100000 and o_orderstatus eq 'F'", "$select": "o_totalprice", "$orderby": "o_totalprice desc", "$top": "10"})
