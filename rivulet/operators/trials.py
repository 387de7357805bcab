"""Paired trials: the same change brought in by the engine and by a full rebuild, compared and timed."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from rivulet.operators.compare import compare_tables, ratio, status
from rivulet.operators.engine import Engine, Policy
from rivulet.operators.meter import metered
from rivulet.operators.variants import BEFORE, MODELS
from rivulet.queries import root
from rivulet.sources.models import model, source


def models() -> list:
    """The models that scenarios keep up to date."""
    return [source("events", "date(ts)", "event_id"), source("customer", None, "c_custkey"), model("daily", MODELS["daily"], "day"), model("facts", MODELS["facts"], "date(ts)"), model("segments", MODELS["segments"], "day")]


def trial(spark: SparkSession, sf_dir: str, scenario: str) -> dict:
    """One scenario: ratios of the run's time and scanned rows to a rebuild's, and whether both give the same tables.

    A crash is a result like any other.
    """
    try:
        e = Engine(spark, models(), root(spark), Policy(settle=timedelta(0)))
        tables = dict(zip(("events", "customer"), BEFORE[scenario], strict=True))
        now = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        for t, before in tables.items():
            e.load(t, before(now[t]) if before else now[t])
        e.build_all()
        for t, before in tables.items():
            if before:
                e.load(t, now[t])
                e.signal(t, "ALL", datetime(2024, 1, 1))
        began = time.perf_counter()
        with metered(spark) as work:
            report = e.run_once(datetime(2024, 2, 1))
            partial = time.perf_counter() - began
        found = {n: (e.frame(n), dict(e.store.parts(n))) for n in ("daily", "facts", "segments")}
        began = time.perf_counter()
        with metered(spark) as rebuild:
            e.build_all()
            whole = time.perf_counter() - began
        equal = all(compare_tables(df, e.frame(n)).equal for n, (df, _) in found.items())
        cost = ratio(partial, whole)
        return {"scenario": scenario, "ratio": cost, "seconds": partial, "rebuild_seconds": whole, "scan_ratio": ratio(work.rows, rebuild.rows), "rows": work.rows, "rebuild_rows": rebuild.rows, "status": status(cost, equal), "steps": report.steps}
    except Exception as x:
        return {"scenario": scenario, "ratio": float("nan"), "status": "failed", "error": str(x)[:300]}
