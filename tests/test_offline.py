"""Contracts that run without a cluster, and classification of edges."""

import json
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructType, TimestampNTZType

from rivulet import cli
from rivulet.functions.predicates import day_ranges, in_partitions, token
from rivulet.operators import compare, costmodel, detect, fingerprints, graph
from rivulet.plans.lineage import CatalystUsage, relevance
from rivulet.plans.strategy import analyze_edge, changed_outputs
from rivulet.sources import tables
from rivulet.sources.models import Dag, load_models, model, source
from rivulet.streaming.signals import signal_stream, windowed

UTC = timezone.utc
SCHEMAS = {
    "orders": StructType().add("order_id", IntegerType()).add("customer_id", IntegerType()).add("amount", DoubleType()).add("status", StringType()).add("order_date", DateType()).add("last_upd_ts", TimestampNTZType()),
    "customers": StructType().add("customer_id", IntegerType()).add("segment", StringType()),
}
D = "date(last_upd_ts)"
CASES = [
    ("select * from {orders} where status <> 'x'", D, "orders", "aligned"),
    ("select cast(last_upd_ts as date) as d, sum(amount) as r from {orders} group by 1", "d", "orders", "aligned"),
    ("select order_date, sum(amount) as r from {orders} group by 1", "order_date", "orders", "data_dependent"),
    ("with m as (select customer_id, max(last_upd_ts) as last_upd_ts from {orders} group by 1) select * from m", D, "orders", "keyed"),
    ("select * from (select *, row_number() over (partition by customer_id order by last_upd_ts desc, order_id) as rn from {orders}) as x where rn = 1", D, "orders", "keyed"),
    ("select o.*, c.segment from {orders} as o left join {customers} as c on o.customer_id = c.customer_id", D, "customers", "outer_join"),
    ("select o.*, c.segment from {orders} as o full join {customers} as c on o.customer_id = c.customer_id", D, "customers", "full"),
    ("select o.*, c.segment from {orders} as o left join {customers} as c on o.customer_id > c.customer_id", D, "customers", "full"),
    ("select * from {orders} limit 3", D, "orders", "full"),
    ("select a.* from {orders} as a join {orders} as b on a.order_id = b.order_id", D, "orders", "full"),
    ("select * from {orders} where amount > (select avg(amount) from {orders})", D, "orders", "full"),
    ("select * from {orders} where rand() < 0.5", D, "orders", "full"),
    ("select * from {orders} union all select * from {orders}", D, "orders", "full"),
    ("select no_such from {orders}", D, "orders", "full"),
    ("select customer_id, last_upd_ts, sum(amount) over (partition by customer_id) as s from {orders}", D, "orders", "keyed"),
    ("select last_upd_ts, sum(amount) over (order by order_id) as s from {orders}", D, "orders", "full"),
    ("select date(last_upd_ts) as d, status, count(*) as n from {orders} group by grouping sets ((1, 2), (2))", "d", "orders", "full"),
]


@pytest.mark.parametrize(("sql", "part", "parent", "kind"), CASES)
def test_edges(spark, sql, part, parent, kind):
    p = source("orders", D, "order_id") if parent == "orders" else source("customers")
    assert analyze_edge(spark, model("m", sql, part), p, SCHEMAS).kind == kind


def test_changed_outputs(spark):
    of = lambda sql, *c: changed_outputs(spark, model("m", sql), "orders", set(c), SCHEMAS)
    assert of("select order_id, amount * 2 as a from {orders}", "amount") == {"a"}
    assert of("select order_id from {orders} where amount > 1", "amount") is None
    assert of("select customer_id, sum(amount) as s from {orders} group by 1", "amount") == {"s"}
    assert of("select customer_id, sum(amount) as s from {orders} group by 1", "status") == set()
    assert of("select distinct status from {orders}", "status") is None


def test_usage(spark):
    s = CatalystUsage(spark, {"a": "select sum(amount) as s from {orders} where status = 'x'", "b": "select count(*) as n from {orders}", "c": "select x from nowhere"}, SCHEMAS)
    assert s.column_usage("a").used == {"orders": {"amount", "status"}} and s.column_usage("b").used == {"orders": set()}
    assert [r.relevant for r in relevance({"p.orders": [], "orders": ["a", "b", "c", "d"]}, "orders", ["amount"], s)] == [True, False, True, True]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, d), d) for d in range(1, 9)], "ts timestamp_ntz, v int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    two = df.where(in_partitions(df, "date(ts)", {"v2024-01-02", "v2024-01-05", "n"}))
    assert sorted(r["v"] for r in two.collect()) == [2, 5]
    assert "PushedFilters: [Or(" in two._jdf.queryExecution().executedPlan().toString()
    assert df.where(in_partitions(df, "v", {token(3)})).count() == 1 and df.where(in_partitions(df, "v", set())).count() == 0
    assert day_ranges([date(2024, 1, 2), date(2024, 1, 1), date(2024, 1, 5)]) == [(date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 5), date(2024, 1, 6))]


def test_detection():
    cfg, other = detect.PartitionConfig("t", "a", "a"), detect.PartitionConfig("t", "a", "b", "DATE")
    w = detect.ChangeWindow(datetime(2026, 1, 1, 5, tzinfo=UTC), datetime(2026, 1, 3, tzinfo=UTC))
    assert detect.resolve(cfg, w).days == [date(2026, 1, 1), date(2026, 1, 2)] and not detect.discovery_required(cfg, w) and detect.discovery_required(other, w)
    assert detect.resolve(other, w, [date(2026, 1, 5), date(2026, 1, 4)]).ranges == ((date(2026, 1, 4), date(2026, 1, 5)),)
    with pytest.raises(detect.UnsupportedPartitionError):
        detect.resolve(other, w, [None])
    with pytest.raises(detect.UnsupportedPartitionError):
        detect.partition_filter_sql(other, detect.Selection(((date(2000, 1, 1), date(2010, 1, 1)),)))
    assert detect.partition_filter_sql(other, detect.Selection(()), "x") == "FALSE" and "DATE '2026-01-04'" in detect.partition_filter_sql(other, detect.select_days([date(2026, 1, 4)]))
    d = detect.DeltaConfig("t", ("k",), "p", ("k", "p", "z", "y"), ("z", "y"))
    assert d.projected == ["k", "p", "y", "z"] and detect.delta_sql(d, "y > 1") == "SELECT `k`, `p`, `y`, `z` FROM t WHERE y > 1"
    with pytest.raises(ValueError):
        detect.delta_sql(d, " ")


def test_graphs_and_plans():
    t = lambda n, *deps: {"target": {"name": n}, "dependencyTargets": [{"name": d} for d in deps]}
    g, r = graph.load_compiled_graph("﻿" + json.dumps({"tables": [t("a", "s"), t("b", "a"), t("c", "a", "s"), t("d", "b", "c"), t("x"), t("x")]}))
    k = lambda n: graph.target({"name": n})
    assert r.duplicates == (k("x"),) and (k("a"), k("s")) in r.missing and not r.cycles
    p = graph.plan(g, [k("s"), "nope"])
    assert [json.loads(s.node)[2] for s in p.steps] == ["a", "b", "c", "d"] and p.unknown == ("nope",)
    assert [json.loads(x)[2] for x in p.steps[-1].path] == ["s", "c", "d"]
    with pytest.raises(graph.GraphCycleError):
        graph.plan(graph.Graph({"a": ("b",), "b": ("a",)}), ["a"])
    with pytest.raises(graph.CompiledGraphError):
        graph.load_compiled_graph({"operations": [1]})


def test_state_and_metadata(spark, tmp_path):
    store, s = graph.SnapshotStore(tmp_path / "s.json"), graph.Snapshot(datetime(2024, 1, 1, tzinfo=UTC), 3)
    assert store.load() == {}
    store.save({"t": s})
    assert store.load() == {"t": s} and graph.compare_snapshots({"t": s}, {"t": s, "u": s}) == {"t": "unchanged", "u": "first_seen"}
    (tmp_path / "s.json").write_text('{"version": 1, "version": 1, "tables": {}}')
    with pytest.raises(graph.StateFormatError):
        store.load()
    spark.range(5).write.parquet(str(tmp_path / "p"))
    ref = tables.TableRef("a-b", "c", "d")
    snap = tables.ParquetMetadataReader(spark, {ref: str(tmp_path / "p")}).get_snapshot(ref)
    assert snap.num_rows == 5 and tables.TableSnapshot.from_dict(snap.to_dict()) == snap
    with pytest.raises(tables.TableNotFoundError):
        tables.FakeMetadataReader().get_snapshot(ref)
    (tmp_path / "c.toml").write_text('[orchestrator]\nmode = "observe"\npoll_interval_seconds = 5\n[bigquery]\nproject = "p"\nlocation = "x"\n')
    assert cli.main(["check-config", str(tmp_path / "c.toml")]) == 0
    (tmp_path / "c.toml").write_text('[orchestrator]\nmode = "act"\n[bigquery]\nproject = "p"\n')
    assert cli.main(["check-config", str(tmp_path / "c.toml")]) == 2


def test_models_from_files(tmp_path):
    (tmp_path / "o.sqlx").write_text('config { type: "declaration", name: "orders", uniqueKey: ["order_id"], bigquery: { partitionBy: "DATE(ts)" } }')
    (tmp_path / "x.sqlx").write_text('config { type: "table" }\nselect * from ${ref("orders")} join ${ref("s", "orders")} using (order_id)')
    dag = Dag(load_models(tmp_path))
    assert dag.order == ["orders", "x"] and dag.models["orders"].partition_expr == "DATE(ts)" and dag.models["orders"].unique_key == "order_id"
    assert dag.models["x"].sql == "select * from {orders} join {orders} using (order_id)" and dag.downstream("orders") == ["x"]
    with pytest.raises(KeyError):
        Dag([model("y", "select * from {gone}")])


def test_fingerprints(spark):
    cfg = fingerprints.FingerprintConfig("t", ("k",), ("b", "a"))
    df = spark.createDataFrame([(1, None, 2), (2, 2, None)], "k int, a int, b int")
    one = fingerprints.fingerprint(df, cfg).first()
    assert one == fingerprints.fingerprint(df.orderBy("b"), cfg).first() and cfg.hashed == ["k", "a", "b"]
    moved = spark.createDataFrame([(1, 2, None), (2, None, 2)], "k int, a int, b int")
    assert one != fingerprints.fingerprint(moved, cfg).first()
    f = fingerprints.Fingerprint(one["hash"], one["n_rows"], tuple(cfg.hashed), datetime(2024, 1, 1, tzinfo=UTC))
    assert fingerprints.Fingerprint.from_dict(f.to_dict()) == f
    assert [fingerprints.decide(cfg, n, b, f) for n, b in ((10**9, None), (2, None), (2, f))] == ["not_eligible", "no_baseline", "unchanged_suppress"]
    assert fingerprints.apply_audit_policy([{"t": "high"}, {"t": "high", "u": "high"}], True) == ["t"]
    with pytest.raises(ValueError):
        fingerprints.fingerprint(df, cfg, "a = 1")


@pytest.mark.parametrize("seed", range(2))
def test_comparison(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 2]), r.choice([None, 1.0, float("nan"), 2.5])) for _ in range(30)]
    a = spark.createDataFrame(rows, "k int, v double")
    shuffled = spark.createDataFrame(random.sample(rows, len(rows)), "k int, v double")
    assert compare.compare_tables(a, shuffled).equal and compare.compare_tables(a, shuffled, 1e-9).equal
    near = a.selectExpr("k", "v * (1 + 1e-12) as v")
    assert compare.compare_tables(a, near, 1e-9).equal and not compare.compare_tables(a, near).equal
    d = compare.compare_tables(a, a.limit(29), 1e-9)
    assert (d.equal, d.missing, d.extra) == (False, 1, 0) and not compare.compare_tables(a, a.drop("v")).equal


def test_reports_and_costs():
    trials = [{"scenario": "x", "ratio": 0.5, "status": "faster"}, {"scenario": "x", "ratio": 2.0, "status": "slower"}, {"scenario": "y", "ratio": 1.0, "status": "incorrect"}]
    text = compare.report(trials, trials[:1])
    assert "| x | 2 | same | 1.000 | 0.500 | 2.000 | 2.00x |" in text and "Wrong or failed: y" in text
    assert compare.ratio(0, 0) == 1 and compare.ratio(1, 0) == 1e6 and compare.status(0.9) == "faster"
    g = costmodel.synthetic(40, 1)
    assert costmodel.PlanGraph.from_json(g.to_json()).to_json() == g.to_json()
    assert 0 < costmodel.evaluate_all(g, costmodel.Assumptions())["geomean"] < 4


def test_stream_signals(spark, tmp_path):
    from rivulet.operators.engine import Engine

    schema = "event_id int, ts timestamp_ntz, value double"
    rows = lambda d, n: spark.createDataFrame([(d * 100 + i, datetime(2024, 1, d, i), 1.0) for i in range(n)], schema)
    e = Engine(spark, [source("events", "date(ts)", "event_id"), model("daily", "select date(ts) as d, count(*) as n from {events} group by 1", "d")], str(tmp_path / "w"))
    e.load("events", rows(1, 4))
    e.build_all()
    rows(1, 6).unionAll(rows(2, 3)).write.parquet(str(tmp_path / "in"))
    signal_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), e, "events", str(tmp_path / "c")).awaitTermination(120)
    assert sorted(tuple(r) for r in e.frame("daily").collect()) == [(date(2024, 1, 1), 6), (date(2024, 1, 2), 3)]
    assert windowed(rows(1, 3)).count() == 3


def test_delimited_text(spark, tmp_path):
    (tmp_path / "l.tbl").write_text("1|2|19950105\n")
    df = tables.with_load_columns(tables.read_delimited(spark, str(tmp_path / "l.tbl"), "lo_orderkey int, lo_linenumber int, lo_orderdate string", dates={"lo_orderdate": "yyyyMMdd"}))
    assert df.first()["lo_rowid"] == 12 and df.first()["lo_loaded_ts"] == datetime(1995, 1, 5, 12)
    tables.clustered(df, str(tmp_path / "out"), "lo_orderdate", 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
