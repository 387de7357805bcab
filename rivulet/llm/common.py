"""What the corpus operators share: shared storage, Arrow batches, size checks."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for tables of fingerprints, classes and nodes, several of which are broadcast in one query.
FEW = 100_000
#: Spark's setting that removes a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of one Arrow batch that Python gets.
BATCH_ROWS, BATCH_BYTES = 1_000, "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset, as
    in tests, a local folder is taken.
    """
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints").rstrip("/")


_scopes = threading.local()


def spool(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts the lineage: what was computed survives lost executors, and later
    reads do not repeat it.  Shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rivulet-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables spooled within are deleted at the end, but for those written with the function it gives.

    Only such a table, or what does not read the others, may leave the scope.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    mine: list[str] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        out = spool(df, what)
        path = mine.pop()
        for scope in scopes[-2:-1]:
            scope.append(path)
        return out

    scopes.append(mine)
    try:
        yield kept
    finally:
        scopes.pop()
        for path in mine:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the batches that Python workers get small, also with long texts, and lets workers find this package.

    Workers look for it where the driver has it, besides their own path; where
    that folder doesn't exist, nothing changes.
    """
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent.parent)
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``fn`` to every Arrow batch; batches hold BATCH_ROWS rows at most."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join deals both sides out by key and broadcasts neither.

    Spark guesses sizes before it runs: an exploded table counts as large as
    what it is made of, a packed one as large as its file.  By such a guess it
    would broadcast, through the driver, what does not fit there.
    """
    return df.hint("merge")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; else dealt out.

    ``df`` should be cheap to count, such as a spooled table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else dealt(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, so that no column of the caller is lost."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def list_array(values, offsets, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and their offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
