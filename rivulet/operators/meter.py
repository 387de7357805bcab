"""Work meter: rows that scans read, and statements, while a block runs.

The counts are those that Spark keeps of every execution (the rows that each
file scan gave after its pruning), so measuring adds no work to the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Work:
    rows: int = 0
    statements: int = 0


def number(text: str) -> int:
    """The total of a metric as shown: alone, or with its spread below it."""
    last = text.strip().split("\n")[-1].split("(")[0]
    return int("".join(c for c in last if c.isdigit()) or 0)


@contextmanager
def metered(spark: SparkSession) -> Iterator[Work]:
    """Counts what the session scans inside the block; the result is complete when the block ends.

    The session keeps the last executions only (``spark.sql.ui.retainedExecutions``);
    a block of more statements than that raises rather than counting too little.
    """
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    seen = {x.executionId() for x in executions(store)}
    last, work = max(seen, default=-1), Work()
    yield work
    bus.waitUntilEmpty()
    found = [x.executionId() for x in executions(store) if x.executionId() > last]
    if seen and found and min(found) > last + 1:
        raise RuntimeError("more statements than the session retains: raise spark.sql.ui.retainedExecutions")
    for i in found:
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if not node.name().startswith("Scan parquet"):
                continue
            metrics = node.metrics()
            for j in range(metrics.size()):
                m = metrics.apply(j)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    work.rows += number(values.apply(m.accumulatorId()))
    work.statements = len(found)


def executions(store) -> list:
    all_of = store.executionsList()
    return [all_of.apply(k) for k in range(all_of.size())]
