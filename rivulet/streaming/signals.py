"""Signals from a stream: each micro-batch of arrived rows marks the partitions that it holds, and may start a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.functions.predicates import value
from rivulet.operators.engine import Engine


def signal_stream(arrivals: DataFrame, engine: Engine, source: str, checkpoint: str, run: bool = True) -> StreamingQuery:
    """Appends what has arrived to a source, then signals its partitions; stops when all is read.

    A batch that is delivered again after a failure is loaded once: rows of the
    source's unique key that are there already are replaced, in whatever
    partition they are.
    """
    m = engine.dag.models[source]

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        tokens = engine.targets(df, m.partition_expr) if m.partition_expr else None
        if m.unique_key and tokens is not None:
            # versions of the arrived keys that lie in other partitions go as well
            old = engine.store.read(source)
            tokens |= engine.targets(old.join(df.select(m.unique_key).distinct(), m.unique_key, "left_semi"), m.partition_expr)
        there = engine.store.read(source, tokens=tokens)
        if m.unique_key:
            there = there.join(df.select(m.unique_key), m.unique_key, "left_anti").select(*there.columns)
        engine.load(source, there.unionByName(df.select(*there.columns)), tokens)
        if tokens:
            engine.signal(source, [value(t) for t in sorted(tokens)], datetime.now() - engine.policy.settle)
        elif tokens is None:
            engine.signal(source, "ALL", datetime.now() - engine.policy.settle)
        if run:
            engine.run_once()
        df.unpersist()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by window of event time; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size)).agg(F.count("*").alias("n"))
