"""Deterministic changes of tables: variants of the data, and scenarios of what arrives between two runs.

Rows are chosen by the MD5 of a key and a seed, so any engine can choose the
same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANTS = ("clean", "nulls", "duplicates", "unmatched_keys", "empty_partitions", "skewed_keys", "ties")
SCENARIOS = ("unchanged_no_signal", "unchanged_resignal", "new_day", "backfill_7_days", "late_updates_recent", "late_updates_scattered", "dimension_change", "source_column_added", "edge_mix")


def chosen(key: str, seed: str, share: str) -> str:
    """SQL that holds for a share of the keys: '0' for one in 16, '01' for two and so on (first hexadecimal digits)."""
    return f"substring(md5(concat(cast({key} as string), '{seed}')), 1, 1) in ({', '.join(repr(c) for c in share)})"


def sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows, the same ones on every run: a total order by hash, then key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def variant(df: DataFrame, kind: str) -> DataFrame:
    """A variant of orders."""
    pick = chosen("o_orderkey", kind, "0")
    if kind == "clean":
        return df
    if kind == "nulls":
        return df.withColumn("o_custkey", F.expr(f"if({pick}, null, o_custkey)"))
    if kind == "duplicates":
        return df.unionAll(df.where(pick))
    if kind == "unmatched_keys":
        return df.withColumn("o_custkey", F.expr(f"if({pick}, -o_custkey - 1, o_custkey)"))
    if kind == "empty_partitions":
        return df.where("month(o_orderdate) <> 6")
    if kind == "skewed_keys":
        return df.withColumn("o_custkey", F.expr(f"if({chosen('o_orderkey', kind, '01234567')}, cast(1 as bigint), o_custkey)"))
    if kind == "ties":
        return df.withColumn("o_totalprice", F.expr(f"if({pick}, 1000.0D, o_totalprice)"))
    raise ValueError(f"no such variant: {kind}")


#: What each scenario leaves out of, or had otherwise in, the state before: for events, and for customers.
BEFORE: dict[str, tuple[Callable[[DataFrame], DataFrame] | None, Callable[[DataFrame], DataFrame] | None]] = {
    "unchanged_no_signal": (None, None),
    "unchanged_resignal": (lambda e: e, None),
    "new_day": (lambda e: e.where("date(ts) < date'2024-01-30'"), None),
    "backfill_7_days": (lambda e: e.where("date(ts) not between date'2024-01-05' and date'2024-01-11'"), None),
    "late_updates_recent": (lambda e: e.withColumn("value", F.expr(f"if(date(ts) >= date'2024-01-28' and {chosen('event_id', 'late', '01')}, value + 1, value)")), None),
    "late_updates_scattered": (lambda e: e.withColumn("value", F.expr(f"if({chosen('event_id', 'scattered', '0')}, value + 1, value)")), None),
    "dimension_change": (None, lambda c: c.withColumn("c_mktsegment", F.expr(f"if({chosen('c_custkey', 'dim', '0')}, 'OTHER', c_mktsegment)"))),
    "source_column_added": (lambda e: e.drop("props"), None),
    "edge_mix": (lambda e: e.where(f"not {chosen('event_id', 'mix', '0')}"), lambda c: c.where(f"not {chosen('c_custkey', 'mix', '0')}")),
}
#: Models that the scenarios keep up to date.
MODELS = {
    "daily": "select cast(ts as date) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from {events} group by cast(ts as date), event_type",
    "facts": "select e.event_id, e.user_id, e.ts, e.value, c.c_mktsegment from {events} as e left join {customer} as c on e.user_id = c.c_custkey",
    "segments": "select cast(ts as date) as day, c_mktsegment, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from {facts} group by cast(ts as date), c_mktsegment",
}


def scenario(kind: str, result: str = "segments"):
    """A query that builds the models on the state before, brings them up to date, and returns one."""

    def query(spark, sf_dir):
        from datetime import datetime, timedelta

        from rivulet.operators.engine import Engine, Policy
        from rivulet.queries import root
        from rivulet.sources.models import model, source

        models = [source("events", "date(ts)", "event_id"), source("customer", None, "c_custkey"), model("daily", MODELS["daily"], "day"), model("facts", MODELS["facts"], "date(ts)"), model("segments", MODELS["segments"], "day")]
        e = Engine(spark, models, root(spark), Policy(settle=timedelta(0)))
        for t, before in zip(("events", "customer"), BEFORE[kind], strict=True):
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            e.load(t, before(df) if before else df)
        e.build_all()
        for t, before in zip(("events", "customer"), BEFORE[kind], strict=True):
            if before:
                e.load(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
                e.signal(t, "ALL", datetime(2024, 1, 1))
        e.run_once(datetime(2024, 2, 1))
        return e.frame(result)

    return query


#: Layouts of the upstream table: what a load partitions it by.
LAYOUTS = {"load_day": "date(ts)", "event_type": "event_type", "unpartitioned": None}


def remapped(df: DataFrame, days: list[str], layout: str) -> DataFrame:
    """Partitions of a layout that hold the rows of some days."""
    rows = df.where(F.expr("date(ts)").isin([F.lit(d).cast("date") for d in days]))
    part = F.expr(LAYOUTS[layout]).cast("string") if LAYOUTS[layout] else F.lit("ALL")
    return rows.select(part.alias("partition")).distinct()


def duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)").replace("1000.0D", "1000.0::double")


def queries() -> dict:
    read = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")
    summary = "count(*) as n, count(o_custkey) as n_keys, count(distinct o_custkey) as n_customers, count(distinct cast(date_trunc('month', o_orderdate) as date)) as n_months, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total"
    pick = lambda k, s="0": duck(chosen("o_orderkey", k, s))
    shaped = {
        "clean": "select * from orders",
        "nulls": f"select * replace (case when {pick('nulls')} then null else o_custkey end as o_custkey) from orders",
        "duplicates": f"select * from orders union all select * from orders where {pick('duplicates')}",
        "unmatched_keys": f"select * replace (case when {pick('unmatched_keys')} then -o_custkey - 1 else o_custkey end as o_custkey) from orders",
        "empty_partitions": "select * from orders where month(o_orderdate) <> 6",
        "skewed_keys": f"select * replace (case when {pick('skewed_keys', '01234567')} then 1 else o_custkey end as o_custkey) from orders",
        "ties": f"select * replace (case when {pick('ties')} then 1000.0::double else o_totalprice end as o_totalprice) from orders",
    }
    out = {f"variant_{k}": ((lambda s, d, k=k: s.sql(f"select {summary} from {{v}}", v=variant(read(s, d, "orders"), k))), f"select {summary} from ({shaped[k]})") for k in VARIANTS}
    segments = MODELS["segments"].replace("{facts}", f"({MODELS['facts']})").replace("{", "").replace("}", "")
    out |= {f"scenario_{k}": (scenario(k), segments) for k in SCENARIOS}
    out["layout_remap"] = (lambda s, d: remapped(read(s, d, "events"), ["2024-01-03", "2024-01-04"], "event_type"), "select distinct event_type as \"partition\" from events where cast(ts as date) in (date '2024-01-03', date '2024-01-04')")
    out["deterministic_sample"] = (lambda s, d: sample(read(s, d, "orders"), "o_orderkey", "seed", 20).select("o_orderkey"), "select o_orderkey from orders order by md5(concat(cast(o_orderkey as varchar), 'seed')), o_orderkey limit 20")
    return out
