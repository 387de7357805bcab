"""Schema changes, upserts across partitions, paths of plans, settings, audit columns, cycles and the cost model."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.operators import costmodel, fingerprints, graph
from rivulet.operators.engine import Engine, Policy
from rivulet.sources.models import model, settings_of, source
from rivulet.sources.tables import Settings, load_settings

CHAIN = [source("ev", "date(ts)", "id"), model("a", "select * from {ev}", "date(ts)"), model("b", "select * from {a}", "date(ts)")]


@pytest.mark.parametrize("change", [lambda df: df.withColumn("extra", F.lit(1)), lambda df: df.drop("v"), lambda df: df.withColumn("v", F.col("v").cast("string"))])
def test_run_equals_rebuild_under_schema_change(spark, tmp_path, change):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 4), i) for i in range(20)], "id int, ts timestamp, v int")
    e = Engine(spark, CHAIN, str(tmp_path / "w"))
    e.load("ev", rows)
    e.build_all()
    e.load("ev", change(rows))
    e.on_change("ev")
    now = {n: (e.frame(n).schema.simpleString(), sorted(map(tuple, e.frame(n).collect()))) for n in "ab"}
    e.build_all()
    assert now == {n: (e.frame(n).schema.simpleString(), sorted(map(tuple, e.frame(n).collect()))) for n in "ab"}


def test_upsert_moves_between_partitions(spark, tmp_path):
    from rivulet.streaming.signals import signal_stream

    kind = "id int, ts timestamp, v int"
    e = Engine(spark, CHAIN, str(tmp_path / "w"), Policy(settle=timedelta(0)))
    e.load("ev", spark.createDataFrame([(1, datetime(2024, 1, 1), 1), (2, datetime(2024, 1, 1), 2)], kind))
    e.build_all()
    spark.createDataFrame([(1, datetime(2024, 1, 2), 9)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    signal_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), e, "ev", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in e.frame("ev").collect()) == [(1, 9), (2, 2)]
    assert sorted((r["id"], r["v"]) for r in e.frame("b").collect()) == [(1, 9), (2, 2)]


def test_paths_begin_at_another_changed_node():
    steps = {s.node: s for s in graph.plan(graph.Graph({"a": ("src",), "b": ("a",)}), ["src", "a"]).steps}
    assert (steps["a"].path, steps["a"].triggers) == (("src", "a"), ("src",))
    assert (steps["b"].path, steps["b"].triggers) == (("a", "b"), ("a", "src"))


def test_cycles_against_reachability():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 9)
        parents = {f"n{i}": tuple({f"n{r.randrange(n)}" for _ in range(r.randrange(3))}) for i in range(n)}
        far = {a: set(ps) for a, ps in parents.items()}
        for _ in range(n):
            far = {a: ps | {x for p in ps for x in far[p]} for a, ps in far.items()}
        groups = {tuple(sorted(b for b in far if b == a or (b in far[a] and a in far[b]))) for a in far if a in far[a]}
        assert graph.cycles(graph.Graph(parents)) == sorted(groups)


def test_settings(tmp_path):
    def load(text):
        (tmp_path / "s.toml").write_text(text)
        return load_settings(tmp_path / "s.toml")

    assert load('[bigquery]\nproject = " p "\n') == Settings("p", "US", 300, "observe")
    assert load('[orchestrator]\nmode = "observe"\npoll_interval_seconds = 60\n[bigquery]\nproject = "p"\nlocation = "EU"') == Settings("p", "EU", 60)
    for bad, word in [("", "bigquery.project"), ('[bigquery]\nproject = 4', "bigquery.project"), ('[orchestrator]\nmode = "x"\n[bigquery]\nproject = "p"', "observe"), ('[orchestrator]\npoll_interval_seconds = true\n[bigquery]\nproject = "p"', "positive"), ("[x]\ny = 1", "Unknown configuration"), ('[bigquery]\nproject = "p"\nlocaton = "US"', "Unknown bigquery"), ('orchestrator = "observe"', "TOML table")]:
        with pytest.raises(ValueError, match=word):
            load(bad)


def test_config_blocks():
    said, body = settings_of('-- a config\nconfig { type: "table", // a } here\n bigquery: { partitionBy: "date(x)", note: "}" }, uniqueKey: ["id", "b"] }\nselect "}" from t')
    assert said["type"] == "table" and said["partitionBy"] == "date(x)" and said["uniqueKey"] == "id" and body == '-- a config\n\nselect "}" from t'
    with pytest.raises(ValueError):
        settings_of("config { a: 'b'")


def test_audit_columns(spark):
    t = lambda d: datetime(2024, 1, d)
    kind = "k int, v int, u timestamp, w timestamp"
    table = lambda *rows: spark.createDataFrame(list(rows), kind)
    found = lambda a, b: {r["column"]: r["confidence"] for r in fingerprints.audit_columns(a, b, ["k"]).collect()}
    before = table((1, 5, t(1), t(9)), (2, 6, t(1), t(9)))
    assert found(before, table((1, 5, t(2), t(9)), (2, 6, t(3), t(9)))) == {"u": "high", "w": "low"}
    assert found(before, table((1, 7, t(2), t(9)), (2, 6, t(3), t(9)))) == {"w": "low"}
    assert found(before, table((1, 5, t(2), t(9)), (3, 6, t(3), t(9)))) == {} and found(before.limit(1), before.limit(1)) == {}
    assert found(before, table((1, 5, t(2), None), (2, 6, t(1), t(9)))) == {}


def test_cost_shares_add_up():
    g = costmodel.PlanGraph({"s": {"bytes": 100.0, "source": True}, "t": {"bytes": 50.0, "source": True}, "x": {"bytes": 10.0}, "y": {"bytes": 10.0, "view": True}, "z": {"bytes": 5.0}}, [("s", "x", "keyed"), ("t", "x", "aligned"), ("s", "y", "data_dependent"), ("x", "z", "aligned"), ("y", "z", "aligned")])
    a = costmodel.Assumptions(changed_fraction=0.1, hash_overhead=False)
    r = costmodel.evaluate(g, "s", a)
    # x: 3 * 0.1 dirty, 0.4 of s read; y passes 0.2 on; z: 0.3 + 0.2 dirty
    assert r["cone"] == 2 and r["part"]["write"] == pytest.approx(0.3 * 10 + 0.5 * 5) and r["part"]["scan"] == pytest.approx(40 + 0.3 * 10 + 0.2 * 10)
    every = costmodel.evaluate_all(g, a)
    assert every["signals"] == 2 and every["scan_ratio_min"] <= every["scan_ratio_median"] <= every["scan_ratio_max"]
