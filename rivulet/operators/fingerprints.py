"""Content fingerprints of small tables, key-level differences, and audit columns."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.predicates import row_hash
from rivulet.operators.detect import name


@dataclass(frozen=True)
class FingerprintConfig:
    """Keys and content of a table, and the size up to which it is worth reading whole."""

    table: str
    key_columns: tuple[str, ...]
    content_columns: tuple[str, ...]
    max_rows: int = 1_000_000

    def __post_init__(self) -> None:
        every = [name(c).lower() for c in (*self.key_columns, *self.content_columns)]
        if not self.key_columns or len(set(every)) != len(every):
            raise ValueError("no key, or a repeated column")

    @property
    def hashed(self) -> list[str]:
        return [*self.key_columns, *sorted(self.content_columns)]


@dataclass(frozen=True)
class Fingerprint:
    """XOR of row hashes and the number of rows.  Equal rows cancel in pairs, so keys must be unique."""

    hash: int
    rows: int
    columns: tuple[str, ...]
    computed_at: datetime

    def __post_init__(self) -> None:
        if not -(1 << 63) <= self.hash < 1 << 63:
            raise ValueError("hash is no signed 64-bit number")
        if self.computed_at.tzinfo is None:
            raise ValueError("time needs a zone")
        object.__setattr__(self, "computed_at", self.computed_at.astimezone(timezone.utc))

    def to_dict(self) -> dict:
        return asdict(self) | {"columns": list(self.columns), "computed_at": self.computed_at.isoformat()}

    @staticmethod
    def from_dict(d: dict) -> Fingerprint:
        if set(d) != {"hash", "rows", "columns", "computed_at"}:
            raise ValueError("other fields than a fingerprint's")
        return Fingerprint(d["hash"], d["rows"], tuple(d["columns"]), datetime.fromisoformat(d["computed_at"]))


def key_hashes(df: DataFrame, cfg: FingerprintConfig, where: str | None = None) -> DataFrame:
    """Keys and the hash of each row."""
    rows = df.where(filter_checked(where, cfg)) if where else df
    return rows.select(*cfg.key_columns, row_hash(cfg.hashed).alias("row_hash"))


FILTER = re.compile(r"\s*`?(\w+)`?\s+IN\s*\(\s*(DATE\s*'\d{4}-\d\d-\d\d'(?:\s*,\s*DATE\s*'\d{4}-\d\d-\d\d')*)\s*\)\s*", re.I)


def filter_checked(text: str, cfg: FingerprintConfig) -> str:
    """Only a list of days of one hashed column may narrow a fingerprint."""
    m = FILTER.fullmatch(text)
    if not m or m[1] not in cfg.hashed:
        raise ValueError(f"no filter by days of a hashed column: {text!r}")
    for d in re.findall(r"\d{4}-\d\d-\d\d", m[2]):
        date.fromisoformat(d)
    return text


def fingerprint(df: DataFrame, cfg: FingerprintConfig, where: str | None = None) -> DataFrame:
    """One row: hash and rows."""
    return key_hashes(df, cfg, where).agg(F.coalesce(F.bit_xor("row_hash"), F.lit(0).cast("long")).alias("hash"), F.count(F.lit(1)).alias("n_rows"))


def decide(cfg: FingerprintConfig, rows: int, before: Fingerprint | None, now: Fingerprint) -> str:
    if rows > cfg.max_rows:
        return "not_eligible"
    if before is None or tuple(before.columns) != tuple(cfg.hashed):
        return "no_baseline"
    return "unchanged_suppress" if (before.hash, before.rows) == (now.hash, now.rows) else "changed"


def diff_keys(before: DataFrame, now: DataFrame, cfg: FingerprintConfig) -> DataFrame:
    """Keys that were added, removed or modified; null is a key like others."""
    a = key_hashes(before, cfg).withColumnsRenamed({k: f"__{k}" for k in cfg.key_columns} | {"row_hash": "h_before"})
    b = key_hashes(now, cfg)
    on = reduce(Column.__and__, [a[f"__{k}"].eqNullSafe(b[k]) for k in cfg.key_columns])
    what = F.when(F.col("h_before").isNull(), "added").when(F.col("row_hash").isNull(), "removed").when(F.col("h_before") != F.col("row_hash"), "modified")
    keys = [F.when(F.col("row_hash").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in cfg.key_columns]
    return a.join(b, on, "full").select(*keys, what.alias("change")).where("change is not null")


def audit_columns(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Time columns that look like audit columns: column, confidence (high or low).

    High: the column changed on every row while all other columns stayed.  Low:
    it has one value in all rows of both tables.  Nulls speak against both, and
    there is no answer unless both tables have the same two keys or more.
    """
    times = [f.name for f in now.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz") and f.name not in keys]
    content = [c for c in now.columns if c not in keys]
    both = before.alias("a").join(now.alias("b"), reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full")
    there = reduce(Column.__or__, [F.col(f"a.{c}").isNotNull() for c in before.columns]) & reduce(Column.__or__, [F.col(f"b.{c}").isNotNull() for c in now.columns])
    stays = {c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in content}
    sums = [F.count("*").alias("rows"), F.bool_and(there).alias("matched")]
    for t in times:
        a, b = F.col(f"a.{t}"), F.col(f"b.{t}")
        rest = reduce(Column.__and__, [s for c, s in stays.items() if c != t], F.lit(True))
        sums += [F.bool_and(F.coalesce(a != b, F.lit(False)) & rest).alias(f"high_{t}"), F.bool_and(F.coalesce(a == b, F.lit(False))).alias(f"still_{t}"), (F.min(a) == F.max(b)).alias(f"one_{t}")]
        sums += [(F.max(a) == F.min(b)).alias(f"flat_{t}")]
    one = both.agg(*sums).where("rows >= 2 and matched")
    low = lambda t: F.col(f"still_{t}") & F.col(f"one_{t}") & F.col(f"flat_{t}")
    rows = F.array(*(F.struct(F.lit(t).alias("column"), F.when(F.col(f"high_{t}"), "high").when(low(t), "low").alias("confidence")) for t in times))
    return one.select(F.explode(rows).alias("r")).select("r.*").where("confidence is not null")


def apply_audit_policy(runs: list[dict[str, str]], auto_apply: bool = False) -> list[str]:
    """Columns found high in the last two runs in a row, if they may be applied."""
    if not auto_apply or len(runs) < 2:
        return []
    return sorted(c for c in runs[-1] if runs[-1][c] == "high" and runs[-2].get(c) == "high")


def queries() -> dict:
    cfg = FingerprintConfig("customer", ("c_custkey",), ("c_name", "c_acctbal", "c_mktsegment"))
    read = lambda s, d, t="customer": s.read.parquet(f"{d}/{t}.parquet")
    other = lambda df: df.where("c_custkey % 11 != 0").withColumn("c_acctbal", F.expr("if(c_custkey % 13 = 0, c_acctbal + 1, c_acctbal)")).withColumn("c_custkey", F.expr("if(c_custkey % 17 = 1, -c_custkey, c_custkey)"))
    sql = """with b as (select case when c_custkey % 17 = 1 then -c_custkey else c_custkey end as k, c_name as n, case when c_custkey % 13 = 0 then c_acctbal + 1 else c_acctbal end as a, c_mktsegment as m from customer where c_custkey % 11 <> 0)
 select coalesce(c_custkey, k) as c_custkey, case when k is null then 'added' when c_custkey is null then 'removed' else 'modified' end as change
 from customer full join b on c_custkey = k where k is null or c_custkey is null or (c_name, c_acctbal, c_mktsegment) is distinct from (n, a, m)"""

    def decided(s, d):
        one, two = fingerprint(read(s, d), cfg).alias("x"), fingerprint(other(read(s, d)), cfg).alias("y")
        both = one.selectExpr("hash as h1", "n_rows as n1", "1 as k").join(two.selectExpr("hash as h2", "n_rows as n2", "1 as k"), "k")
        return both.selectExpr("n1 as rows_before", "n2 as rows_now", "h1 <> h2 or n1 <> n2 as changed")

    def audited(s, d):
        now = read(s, d, "orders").selectExpr("o_orderkey", "o_totalprice", "o_orderdate as updated", "timestamp'2024-01-01' as loaded", "o_orderdate as placed")
        return audit_columns(now.withColumn("updated", F.expr("updated - interval 1 day")), now, ["o_orderkey"])

    audit_sql = """with n as (select o_orderkey as k, o_orderdate as updated, timestamp '2024-01-01' as loaded, o_orderdate as placed from orders),
 b as (select k, updated - interval 1 day as updated, loaded, placed from n), j as (select n.*, b.updated as u, b.loaded as l, b.placed as p from n join b using (k))
 select * from (select 'updated' as "column", case when bool_and(updated <> u and loaded = l and placed = p) then 'high' when min(u) = max(updated) and max(u) = min(updated) then 'low' end as confidence from j
 union all select 'loaded', case when bool_and(loaded <> l and updated = u and placed = p) then 'high' when min(l) = max(loaded) and max(l) = min(loaded) then 'low' end from j
 union all select 'placed', case when bool_and(placed <> p and updated = u and loaded = l) then 'high' when min(p) = max(placed) and max(p) = min(placed) then 'low' end from j) where confidence is not null"""

    return {
        "fingerprint_diff_keys": (lambda s, d: diff_keys(other(read(s, d)), read(s, d), cfg), sql),
        "fingerprint_decide": (decided, "select count(*) as rows_before, count(*) filter (where c_custkey % 11 <> 0) as rows_now, true as changed from customer"),
        "audit_candidates": (audited, audit_sql),
    }
