"""Table metadata, settings, and reading delimited text."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.detect import name
from rivulet.operators.graph import Snapshot


class TableNotFoundError(KeyError):
    pass


@dataclass(frozen=True)
class TableRef:
    project: str
    dataset: str
    table: str

    def __post_init__(self) -> None:
        name(self.project.replace("-", "_")), name(self.dataset), name(self.table)

    def to_dict(self) -> dict:
        return {"project": self.project, "dataset": self.dataset, "table": self.table}

    @staticmethod
    def from_dict(d: dict) -> TableRef:
        if set(d) != {"project", "dataset", "table"}:
            raise ValueError("other fields than a table's")
        return TableRef(**d)


@dataclass(frozen=True)
class TableSnapshot:
    ref: TableRef
    modified_time: datetime
    num_rows: int
    partitioning_column: str | None = None

    def __post_init__(self) -> None:
        Snapshot(self.modified_time, self.num_rows)
        object.__setattr__(self, "modified_time", self.modified_time.astimezone(timezone.utc))

    def to_dict(self) -> dict:
        return {"ref": self.ref.to_dict(), "modified_time": self.modified_time.isoformat(), "num_rows": self.num_rows, "partitioning_column": self.partitioning_column}

    @staticmethod
    def from_dict(d: dict) -> TableSnapshot:
        if set(d) != {"ref", "modified_time", "num_rows", "partitioning_column"}:
            raise ValueError("other fields than a snapshot's")
        return TableSnapshot(TableRef.from_dict(d["ref"]), datetime.fromisoformat(d["modified_time"]), d["num_rows"], d["partitioning_column"])


class MetadataReader(Protocol):
    def get_snapshot(self, ref: TableRef) -> TableSnapshot: ...


class FakeMetadataReader:
    """Snapshots that a test has set."""

    def __init__(self) -> None:
        self.known: dict[TableRef, TableSnapshot] = {}

    def set_snapshot(self, s: TableSnapshot) -> None:
        self.known[s.ref] = s

    def get_snapshot(self, ref: TableRef) -> TableSnapshot:
        if ref not in self.known:
            raise TableNotFoundError(ref)
        return self.known[ref]


class ParquetMetadataReader:
    """Snapshots of Parquet tables: rows as their footers say, time of the latest file, through Spark's own file access."""

    def __init__(self, spark: SparkSession, paths: dict[TableRef, str]) -> None:
        self.spark, self.paths = spark, paths

    def get_snapshot(self, ref: TableRef) -> TableSnapshot:
        if ref not in self.paths:
            raise TableNotFoundError(ref)
        df = self.spark.read.parquet(self.paths[ref])
        r = df.select(F.col("_metadata.file_modification_time").alias("t")).agg(F.unix_micros(F.max("t")).alias("t"), F.count("*").alias("n")).first()
        return TableSnapshot(ref, datetime.fromtimestamp((r["t"] or 0) / 1e6, timezone.utc), r["n"])


@dataclass(frozen=True)
class Settings:
    project: str
    location: str = "US"
    poll_interval_seconds: int = 300
    mode: str = "observe"


#: Sections of a settings file, their entries, and what each must be.
ENTRIES = {
    "orchestrator": {"mode": (lambda x: x == "observe", "only 'observe' is supported"), "poll_interval_seconds": (lambda x: type(x) is int and x > 0, "must be a positive integer")},
    "bigquery": {"project": (lambda x: isinstance(x, str) and x.strip(), "must be a nonempty string"), "location": (lambda x: isinstance(x, str) and x.strip(), "must be a nonempty string")},
}


def load_settings(path: str | Path) -> Settings:
    """Settings from a TOML file; a project must be given, all else has a default."""
    doc = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if extra := sorted(doc.keys() - ENTRIES.keys()):
        raise ValueError(f"Unknown configuration sections: {', '.join(extra)}")
    found = {"project": None}
    for section, entries in ENTRIES.items():
        given = doc.get(section, {})
        if not isinstance(given, dict):
            raise ValueError(f"{section} must be a TOML table")
        if extra := sorted(given.keys() - entries.keys()):
            raise ValueError(f"Unknown {section} settings: {', '.join(extra)}")
        found |= given
        for entry, (good, rule) in entries.items():
            if entry in found and not good(found[entry]):
                raise ValueError(f"{section}.{entry} {rule}")
    return Settings(**{k: v.strip() if isinstance(v, str) else v for k, v in found.items()})


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", dates: dict[str, str] | None = None) -> DataFrame:
    """Delimited text without a header; ``dates`` gives formats of columns that hold dates as text."""
    df = spark.read.schema(schema).option("sep", sep).csv(path)
    for c, form in (dates or {}).items():
        df = df.withColumn(c, F.to_date(F.col(c).cast("string"), form))
    return df


def with_load_columns(lines: DataFrame, order: str = "lo_orderkey", number: str = "lo_linenumber", day: str = "lo_orderdate") -> DataFrame:
    """Order lines with a row id, and a load time up to two days after the order."""
    rowid = F.col(order).cast("long") * 10 + F.col(number)
    loaded = F.expr(f"cast({day} as timestamp_ntz) + make_dt_interval(cast(({order} * 10 + {number}) % 3 as int), cast(({order} * 10 + {number}) % 24 as int))")
    return lines.withColumn("lo_rowid", rowid).withColumn("lo_loaded_ts", loaded)


def clustered(df: DataFrame, path: str, by: str, files: int) -> None:
    """Writes rows in ranges of an expression, sorted, so that row groups can be skipped by it."""
    df.withColumn("__by", F.expr(by)).repartitionByRange(files, "__by").sortWithinPartitions("__by").drop("__by").write.option("parquet.block.size", 8 << 20).parquet(path)
