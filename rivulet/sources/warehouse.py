"""Versioned Parquet tables under one manifest.

A table is a set of partitions, each in some version's folder.  A refresh
writes new folders and then swaps one manifest file, so data and bookkeeping
change together or not at all; a run that dies leaves only folders that nobody
names.  Older versions stay readable until they are collected, which gives the
state before a change for nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rivulet.functions.predicates import ALL, NULL, table_hash, token, value

PART = "__part"
#: Versions whose file listing is remembered.
LISTED = 256


def replace_file(path: Path, text: str) -> None:
    """Writes a file so that readers see the old or the new one, whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(name, path)


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)
        self.path = self.root / "manifest.json"
        self._listed: dict[tuple[str, str, str], DataFrame] = {}
        self.state = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {"tables": {}, "dirty": [], "pending": {}}

    def commit(self) -> None:
        replace_file(self.path, json.dumps(self.state, sort_keys=True))

    def has(self, name: str) -> bool:
        return name in self.state["tables"]

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.state["tables"][name]["schema"])

    def parts(self, name: str) -> dict[str, dict]:
        """Partitions of a table: version, rows and hash of each token."""
        return self.state["tables"][name]["parts"] if self.has(name) else {}

    def rows(self, name: str) -> int:
        return sum(p["rows"] for p in self.parts(name).values())

    def write(self, name: str, df: DataFrame, partition: str | None) -> dict[str, dict]:
        """Writes rows as a new version; returns its partitions.  The manifest stays as it is."""
        version = uuid.uuid4().hex[:12]
        out = f"{self.root}/{name}/{version}"
        part = F.expr(partition).cast("string") if partition else F.lit("*")
        columns = df.columns
        marked = df.withColumn(PART, part)
        # rows of a partition meet in few files; adaptive execution splits large partitions again and joins small ones
        (marked.hint("rebalance", F.col(PART)) if partition else marked.hint("rebalance")).write.partitionBy(PART).parquet(out)
        found = self.version(name, version, df.schema).groupBy(PART).agg(F.count("*").alias("n"), table_hash(columns).alias("h")).collect() if any((self.root / name / version).glob(f"{PART}=*")) else []
        return {(token(r[PART]) if partition else ALL): {"version": version, "rows": r["n"], "hash": r["h"]} for r in found}

    def version(self, name: str, version: str, schema: StructType) -> DataFrame:
        """All rows of a version's folder.  Folders never change once written, so their files are listed once."""
        key = name, version, schema.json()
        if key not in self._listed:
            if len(self._listed) >= LISTED:
                self._listed.clear()
            self._listed[key] = self.spark.read.schema(StructType([*schema.fields]).add(PART, StringType())).parquet(f"{self.root}/{name}/{version}")
        return self._listed[key]

    def read(self, name: str, parts: dict[str, dict] | None = None, tokens: set[str] | None = None) -> DataFrame:
        """A table, or the partitions given of it; ``parts`` may be those of an older state."""
        parts = self.parts(name) if parts is None else parts
        schema, by_version = self.schema(name), {}
        for t, p in parts.items():
            if tokens is None or t in tokens:
                by_version.setdefault(p["version"], []).append(t)
        frames = []
        for v, ts in sorted(by_version.items()):
            df = self.version(name, v, schema)
            keep = [value(t) for t in ts if t not in (ALL, NULL)]
            wanted = F.lit(True) if ALL in ts else F.col(PART).isin(keep) | (F.col(PART).isNull() if NULL in ts else F.lit(False))
            frames.append(df.where(wanted).drop(PART))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def put(self, name: str, df_schema: StructType, parts: dict[str, dict], sql: str = "") -> None:
        """Sets a table's partitions in the manifest, not yet committed."""
        self.state["tables"][name] = {"schema": df_schema.jsonValue(), "sql": sql, "parts": parts}

    def collect_garbage(self) -> int:
        """Removes version folders that neither tables nor open changes name; returns how many."""
        used = {(n, p["version"]) for n, t in self.state["tables"].items() for p in t["parts"].values()}
        used |= {(e["parent"], e["old"]) for e in self.state["dirty"] if e.get("old")}
        used |= {(n, v) for n, old in self.state["pending"].items() for v in old.values() if v}
        gone = [p for n in self.state["tables"] for p in (self.root / n).glob("*") if (n, p.name) not in used]
        self._listed.clear()
        for p in gone:
            shutil.rmtree(p)
        return len(gone)
