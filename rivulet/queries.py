"""Queries of the engine over the test tables, and their SQL.

An incremental query builds a model on an earlier state of the tables, loads
the tables as they are, signals the change, runs the engine once and returns
the model.  Its SQL is the model's own, on the tables as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import compare, costmodel, detect, fingerprints, graph, variants
from rivulet.operators.engine import Engine, Policy
from rivulet.plans import lineage
from rivulet.sources.models import Model, model, source

DAY = datetime(2024, 1, 1)
EVENTS = source("events", "date(ts)", "event_id")
ORDERS = source("orders", "cast(date_trunc('month', o_orderdate) as date)", "o_orderkey")
CUSTOMER = source("customer", "c_mktsegment", "c_custkey")
MONTH = "cast(date_trunc('month', o_orderdate) as date)"
MONEY = lambda x: f"cast(sum(cast({x} as decimal(18,2))) as double)"

Change = Callable[[DataFrame], DataFrame]
same: Change = lambda df: df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def root(spark: SparkSession) -> str:
    """A new warehouse folder that all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    return f"{base.removeprefix('file://').rstrip('/')}/rivulet-warehouse-{uuid.uuid4().hex}"


def incremental(models: list[Model], before: dict[str, Change], result: str, select: tuple[str, ...] = ("*",), policy: Policy | None = None, columns: list[str] | None = None):
    """A query that builds on the tables as ``before`` makes them, then brings ``result`` up to date."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, models, root(spark), policy or Policy(settle=timedelta(0), full_refresh_ratio=1.0))
        names = [m.name for m in models if m.source]
        for n in names:
            e.load(n, before.get(n, same)(table(spark, sf_dir, n)))
        e.build_all()
        for n in before:
            e.load(n, table(spark, sf_dir, n))
            e.signal(n, "ALL", DAY, columns)
        e.run_once(DAY + timedelta(days=1))
        return e.frame(result).selectExpr(*select)

    return query


def without_last_day(df: DataFrame) -> DataFrame:
    return df.where("date(ts) < date'2024-01-30'")


def one_day_altered(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.expr("if(date(ts) = date'2024-01-10', value + 1, value)"))


def late_orders(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.expr("if(o_orderkey % 97 = 0, o_orderdate + interval 40 days, o_orderdate)"))


def other_segment(df: DataFrame) -> DataFrame:
    return df.where("c_custkey % 7 != 3").withColumn("c_acctbal", F.expr("if(c_mktsegment = 'BUILDING', c_acctbal + 1, c_acctbal)"))


DAILY = f"select cast(ts as date) as day, event_type, count(*) as n, {MONEY('value')} as total from {{events}} group by cast(ts as date), event_type"
CHAIN = f"with a as (select *, cast(ts as date) as day from {{events}} where value > 1), b as (select day, user_id, {MONEY('value')} as total, count(*) as n from a group by day, user_id) select day, user_id, total, n from b"
TOPN = "with r as (select event_id, ts, value, row_number() over (partition by cast(ts as date) order by value desc, event_id) as rn from {events}) select event_id, ts, value, cast(rn as bigint) as rn from r where rn <= 2"
BY_TYPE = f"select event_type, count(*) as n, {MONEY('value')} as total from {{events}} group by event_type"
BY_MONTH = f"select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, {MONEY('o_totalprice')} as total from {{orders}} group by cast(date_trunc('month', o_orderdate) as date)"
BY_USER = f"select user_id, max(ts) as last_ts, count(*) as n, {MONEY('value')} as total from {{events}} group by user_id"
LATEST = "select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events}) as x where rn = 1"
LATEST_QUALIFY = "select user_id, event_id, ts, event_type from {events} qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"
KEYED_SRC = "select event_id, nullif(user_id % 5, 0) as grp, ts, value from {events}"
NULL_GROUP = f"select grp, max(ts) as last_ts, count(*) as n, {MONEY('value')} as total from {{grouped}} group by grp"
ENRICHED = "select o.o_orderkey, o.o_custkey, o.o_orderdate, c.c_mktsegment, c.c_acctbal from {orders} as o left join {customer} as c on o.o_custkey = c.c_custkey"
ENRICHED_PART = "select o.o_orderkey, o.o_orderdate, c.c_mktsegment, c.c_acctbal from {orders} as o left join {customer} as c on o.o_custkey = c.c_custkey"
RIGHT = "select o.o_orderkey, o.o_custkey, o.o_orderdate, c.c_acctbal from {customer} as c right join {orders} as o on o.o_custkey = c.c_custkey"
ANTI = "select o.o_orderkey, o.o_custkey, o.o_orderdate from {orders} as o left join {customer} as c on o.o_custkey = c.c_custkey where c.c_custkey is null"
STAR = "select o.*, c.c_mktsegment from {orders} as o left join {customer} as c on o.o_custkey = c.c_custkey"
COMPOSITE = "select o.o_orderkey, o.o_custkey, o.o_orderdate, c.c_acctbal from {orders} as o left join {customer} as c on o.o_custkey = c.c_custkey and o.o_orderstatus = case when c.c_acctbal > 0 then 'F' else 'O' end"
TOP3 = "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 3"
SUBQUERY = "select o_orderkey, o_orderdate, o_totalprice from {orders} where cast(o_totalprice as decimal(18,2)) > (select max(cast(o_totalprice as decimal(18,2))) / 2 from {orders})"
CHEAP = f"select cast(ts as date) as day, count(*) as n from {{events}} where event_type <> 'error' group by cast(ts as date)"
STG = "select o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus from {orders} where o_orderstatus <> 'P'"
FACT = "select s.o_orderkey, s.o_custkey, s.o_orderdate, s.o_totalprice, c.c_mktsegment from {stg} as s join {customer} as c on s.o_custkey = c.c_custkey"
MART = f"select cast(date_trunc('month', o_orderdate) as date) as month, c_mktsegment, count(*) as n, {MONEY('o_totalprice')} as total from {{fact}} group by cast(date_trunc('month', o_orderdate) as date), c_mktsegment"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(sql: str, **inner: str) -> str:
    """A model's SQL over the tables themselves; ``inner`` has the SQL of models that it reads."""
    for k, v in inner.items():
        sql = sql.replace("{" + k + "}", f"({plain(v)})")
    return sql.replace("{", "").replace("}", "")


#: Names of columns that are dates; results give them as text, which reads the same everywhere.
DATES = ("day", "month", "part", "first_day", "last_day")


def as_text(query):
    """A query whose dates are text."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])

    return shown


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = as_text(query)
    if sql is not None:
        dates = [d for d in DATES if re.search(rf" as {d}\b", sql.split(" from ")[0])]
        ORACLES[name] = f"select * replace ({', '.join(f'cast({d} as varchar) as {d}' for d in dates)}) from ({sql})" if dates else sql


def add_incremental(name: str, sql: str, sources: list[Model], before: dict[str, Change], partition: str | None, **options) -> None:
    add(name, incremental([*sources, model("result", sql, partition)], before, "result", **options), plain(sql))


add("full_build_daily_events", incremental([EVENTS, model("result", DAILY, "day")], {}, "result"), plain(DAILY))
add_incremental("inc_aligned_append", DAILY, [EVENTS], {"events": without_last_day}, "day")
add_incremental("inc_aligned_cte_chain", CHAIN, [EVENTS], {"events": without_last_day}, "day")
add_incremental("inc_aligned_window_topn", TOPN, [EVENTS], {"events": without_last_day}, "date(ts)")
add_incremental("inc_data_dependent", BY_TYPE, [EVENTS], {"events": one_day_altered}, "event_type")
add_incremental("inc_upsert_late_update", BY_MONTH, [ORDERS], {"orders": late_orders}, "month")
add_incremental("inc_keyed_groupby", BY_USER, [EVENTS], {"events": one_day_altered}, "date(last_ts)")
add_incremental("inc_keyed_latest_row", LATEST, [EVENTS], {"events": without_last_day}, "date(ts)")
add_incremental("inc_keyed_qualify", LATEST_QUALIFY, [EVENTS], {"events": without_last_day}, "date(ts)")
add("inc_keyed_null_key", incremental([EVENTS, model("grouped", KEYED_SRC, "date(ts)"), model("result", NULL_GROUP, "date(last_ts)")], {"events": one_day_altered}, "result", ("coalesce(grp, -1) as grp", "last_ts", "n", "total")), f"select * replace (coalesce(grp, -1) as grp) from ({plain(NULL_GROUP, grouped=KEYED_SRC)})")
add_incremental("inc_outer_join_key_mode", ENRICHED, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_outer_join_partition_mode", ENRICHED_PART, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_outer_join_right", RIGHT, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_outer_join_anti", ANTI, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_outer_join_star", STAR, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_outer_join_composite", COMPOSITE, [ORDERS, CUSTOMER], {"customer": other_segment}, MONTH)
add_incremental("inc_full_fallback_topk", TOP3, [ORDERS], {"orders": late_orders}, None)
add_incremental("inc_full_fallback_in_subquery", SUBQUERY, [ORDERS], {"orders": late_orders}, MONTH)
add_incremental("inc_cost_rule_full", DAILY, [EVENTS], {"events": lambda df: df.where("date(ts) < date'2024-01-15'")}, "day", policy=Policy(settle=timedelta(0), full_refresh_ratio=0.25, min_rows_for_cost_rules=0))
add_incremental("inc_early_cutoff", CHEAP, [EVENTS], {"events": lambda df: df.withColumn("value", F.expr("if(event_type = 'error', value + 1, value)"))}, "day")
add_incremental("inc_column_relevance_noop", CHEAP, [EVENTS], {"events": one_day_altered}, "day", columns=["value"])
add_incremental("inc_column_relevance_derived", DAILY, [EVENTS], {"events": one_day_altered}, "day", columns=["value"])
add("inc_multi_hop_dag", incremental([ORDERS, CUSTOMER, model("stg", STG, MONTH), model("fact", FACT, MONTH), model("mart", MART, "month")], {"orders": late_orders, "customer": other_segment}, "mart"), plain(MART, fact=FACT.replace("{stg}", f"({STG})")))

ROWS_OF_DAYS = "select * from {events}"
add("inc_schema_added_star", incremental([EVENTS, model("copied", ROWS_OF_DAYS, "date(ts)"), model("again", "select * from {copied}", "date(ts)")], {"events": lambda df: df.drop("value")}, "again"), plain(ROWS_OF_DAYS))

STAR_FROM = """from {lineitem} as l join {orders} as o on l.l_orderkey = o.o_orderkey join {customer} as c on o.o_custkey = c.c_custkey
 join {nation} as cn on c.c_nationkey = cn.n_nationkey join {region} as cr on cn.n_regionkey = cr.r_regionkey
 join {supplier} as s on l.l_suppkey = s.s_suppkey join {nation} as sn on s.s_nationkey = sn.n_nationkey join {region} as sr on sn.n_regionkey = sr.r_regionkey
 join {part} as p on l.l_partkey = p.p_partkey"""
PRICE, RATE = "cast(l.l_extendedprice as decimal(12,2))", "cast(l.l_discount as decimal(4,2))"
REVENUE, DISCOUNTED = MONEY("l.l_extendedprice"), f"cast(sum({PRICE} * {RATE}) as double)"
PROFIT = f"cast(sum({PRICE} * (1 - {RATE})) as double)"
YEAR = "cast(year(o.o_orderdate) as bigint)"
#: Flights: what to group by, what to sum, and the filter.
FLIGHTS = {
    "q1_1": ([YEAR], DISCOUNTED, "year(o.o_orderdate) = 1995 and l.l_discount between 0.01 and 0.03 and l.l_quantity < 25"),
    "q1_2": ([YEAR], DISCOUNTED, "year(o.o_orderdate) = 1994 and month(o.o_orderdate) = 1 and l.l_discount between 0.04 and 0.06 and l.l_quantity between 26 and 35"),
    "q1_3": ([YEAR], DISCOUNTED, "year(o.o_orderdate) = 1994 and l.l_discount between 0.05 and 0.07 and l.l_quantity between 36 and 40"),
    "q2_1": ([YEAR, "p.p_brand"], REVENUE, "p.p_size <= 10 and sr.r_name = 'AMERICA'"),
    "q2_2": ([YEAR, "p.p_brand"], REVENUE, "p.p_size between 20 and 25 and sr.r_name = 'ASIA'"),
    "q2_3": ([YEAR, "p.p_brand"], REVENUE, "p.p_size = 30 and sr.r_name = 'EUROPE'"),
    "q3_1": (["cn.n_name as c_nation", "sn.n_name as s_nation", YEAR], REVENUE, "cr.r_name = 'ASIA' and sr.r_name = 'ASIA' and year(o.o_orderdate) between 1993 and 1997"),
    "q3_2": (["cn.n_name as c_nation", "sn.n_name as s_nation", YEAR], REVENUE, "cn.n_nationkey = 3 and sn.n_nationkey in (3, 4)"),
    "q3_3": (["c.c_mktsegment", "sn.n_name as s_nation", YEAR], REVENUE, "c.c_mktsegment in ('BUILDING', 'MACHINERY') and sn.n_nationkey in (1, 5)"),
    "q3_4": (["c.c_mktsegment", "sn.n_name as s_nation", YEAR], REVENUE, "c.c_mktsegment = 'BUILDING' and year(o.o_orderdate) = 1996 and month(o.o_orderdate) = 12"),
    "q4_1": ([YEAR, "cn.n_name as c_nation"], PROFIT, "cr.r_name = 'AMERICA' and sr.r_name = 'AMERICA' and p.p_size <= 25"),
    "q4_2": ([YEAR, "sn.n_name as s_nation", "p.p_type"], PROFIT, "cr.r_name = 'AMERICA' and sr.r_name = 'AMERICA' and year(o.o_orderdate) in (1996, 1997)"),
    "q4_3": ([YEAR, "sn.n_name as s_nation", "p.p_brand"], PROFIT, "cr.r_name = 'AMERICA' and sn.n_nationkey < 10 and year(o.o_orderdate) in (1996, 1997)"),
}


def run_sql(sql: str):
    """A query of plain SQL over the tables that it names."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [n for n in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part", "events") if "{" + n + "}" in sql]
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    return query


def flight(keys: list[str], measure: str, where: str) -> str:
    keys = [k + " as d_year" if k == YEAR else k for k in keys]
    return f"select {', '.join(keys)}, {measure} as measure {STAR_FROM} where {where} group by {', '.join(k.split(' as ')[0] if ' as d_year' not in k else YEAR for k in keys)}"


for _name, _parts in FLIGHTS.items():
    _sql = flight(*_parts)
    add(f"mart_{_name}", run_sql(_sql), plain(_sql))
FACTS = f"select {YEAR} as d_year, cr.r_name as c_region, sr.r_name as s_region, count(*) as n, {REVENUE} as revenue {STAR_FROM} group by {YEAR}, cr.r_name, sr.r_name"
add("star_fact_sales", run_sql(FACTS), plain(FACTS))

for _module in (detect, fingerprints, graph, compare, variants, costmodel, lineage):
    for _name, (_query, _sql) in _module.queries().items():
        add(_name, _query, _sql)


def entry(spark: SparkSession) -> DataFrame:
    """A day's events arrive, and the daily totals are brought up to date."""
    return QUERIES["inc_aligned_append"](spark, "/root/testdata/sf0.001")
