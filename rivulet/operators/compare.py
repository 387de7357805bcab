"""Comparing tables as multisets of rows, with tolerance for floating point, and reports of trials."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of a trial by its ratio of costs.
FASTER, SLOWER = 0.95, 1.05


@dataclass(frozen=True)
class Difference:
    equal: bool
    reason: str = ""
    missing: int = 0
    extra: int = 0
    samples: tuple = ()


def difference_rows(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows of ``a`` without a partner in ``b`` (side ``missing``) and the reverse (``extra``).

    Null equals null and NaN equals NaN.  With a tolerance, rows that agree in
    all exact columns are ranked by their floating point columns and compared
    rank by rank.
    """
    floats = [f.name for f in a.schema if f.dataType.typeName() in ("double", "float")]
    if not floats or not tolerance:
        return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))
    exact = [c for c in a.columns if c not in floats]
    key = F.xxhash64(*[x for c in exact for x in (F.col(c).cast("string"), F.col(c).isNull())]) if exact else F.lit(0).cast("long")
    rank = F.row_number().over(Window.partitionBy("__k", *exact).orderBy(*[F.col(c).asc_nulls_first() for c in floats]))
    x, y = (df.withColumn("__k", key).withColumn("__r", rank).alias(n) for df, n in ((a, "x"), (b, "y")))

    def close(c: str) -> Column:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        return p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q), F.lit(1.0)), F.lit(False))

    on = (F.col("x.__k") == F.col("y.__k")) & (F.col("x.__r") == F.col("y.__r"))
    for c in exact:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    near = on
    for c in floats:
        near = near & close(c)
    left = x.join(y, near, "left_anti").drop("__k", "__r").withColumn("side", F.lit("missing"))
    right = y.join(x, near, "left_anti").drop("__k", "__r").withColumn("side", F.lit("extra"))
    return left.unionByName(right)


def compare_tables(a: DataFrame, b: DataFrame, tolerance: float = 0.0, samples: int = 5) -> Difference:
    if [(f.name.lower(), f.dataType) for f in a.schema] != [(f.name.lower(), f.dataType) for f in b.schema]:
        return Difference(False, "schemas differ")
    rows = difference_rows(a, b.toDF(*a.columns), tolerance)
    n = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
    if not n:
        return Difference(True)
    return Difference(False, "rows differ", n.get("missing", 0), n.get("extra", 0), tuple(rows.limit(samples).collect()))


def compare_dag(tables: dict[str, tuple[DataFrame, DataFrame]], tolerance: float = 0.0) -> dict[str, Difference]:
    return {n: compare_tables(a, b, tolerance) for n, (a, b) in sorted(tables.items())}


def ratio(x: float, y: float) -> float:
    """x to y; nothing to nothing is 1, something to nothing a million."""
    return 1.0 if x == y == 0 else 1e6 if y == 0 else x / y


def geometric_mean(values: list[float]) -> float:
    return math.exp(sum(math.log(max(v, 1e-6)) for v in values) / len(values)) if values else float("nan")


def status(cost: float, correct: bool = True, error: str = "", supported: bool = True) -> str:
    """What a trial showed."""
    if not supported:
        return "unsupported"
    if error:
        return "failed"
    return "incorrect" if not correct else "faster" if cost < FASTER else "slower" if cost > SLOWER else "same"


def report(trials: list[dict], before: list[dict] | None = None) -> str:
    """A Markdown table of trials by scenario: statuses, mean and range of the ratios, and changes for the worse."""
    earlier = {s: geometric_mean([t["ratio"] for t in before or [] if t["scenario"] == s]) for s in {t["scenario"] for t in before or []}}
    out = ["| scenario | trials | status | ratio | least | most | change |", "|---|---:|---|---:|---:|---:|---:|"]
    for s in sorted({t["scenario"] for t in trials}):
        rows = [t for t in trials if t["scenario"] == s]
        good = [t["ratio"] for t in rows if t["status"] in ("faster", "same", "slower")]
        bad = sorted({t["status"] for t in rows} - {"faster", "same", "slower"})
        mean = geometric_mean(good)
        what = ", ".join(bad) if bad else status(mean)
        delta = f"{mean / earlier[s]:.2f}x" if s in earlier and good else "-"
        out.append(f"| {s} | {len(rows)} | {what} | " + (f"{mean:.3f} | {min(good):.3f} | {max(good):.3f}" if good else "- | - | -") + f" | {delta} |")
    worse = [t["scenario"] for t in trials if t["status"] in ("incorrect", "failed")]
    return "\n".join(out + ([f"\nWrong or failed: {', '.join(sorted(set(worse)))}"] if worse else [])) + "\n"


def middle(values: list[float]) -> float:
    return median(values)


def queries() -> dict:
    read = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")
    count = lambda df: df.groupBy("side").agg(F.count("*").alias("n"))

    def multiset(s, d):
        a = read(s, d, "lineitem").select("l_orderkey", "l_linenumber")
        return count(difference_rows(a.unionAll(a.where("l_orderkey % 10 = 0")), a.where("l_orderkey % 7 <> 0")))

    def floats(s, d):
        a = read(s, d, "orders").select("o_orderkey", "o_totalprice")
        b = a.withColumn("o_totalprice", F.expr("case when o_orderkey % 10 = 0 then o_totalprice * 1.5 else o_totalprice * (1 + 1e-12) end"))
        return count(difference_rows(a, b, 1e-9))

    return {
        "compare_multiset": (multiset, "with a as (select l_orderkey, l_linenumber from lineitem), x as (select * from a union all select * from a where l_orderkey % 10 = 0), y as (select * from a where l_orderkey % 7 <> 0) select 'missing' as side, count(*) as n from (select * from x except all select * from y) having count(*) > 0 union all select 'extra', count(*) from (select * from y except all select * from x) having count(*) > 0"),
        "compare_float_tol": (floats, "select 'missing' as side, count(*) as n from orders where o_orderkey % 10 = 0 union all select 'extra', count(*) from orders where o_orderkey % 10 = 0"),
        "report_geomean": (lambda s, d: read(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.exp(F.avg(F.log(F.greatest(F.col("o_totalprice"), F.lit(1e-6))))), 4).alias("geomean")), "select o_orderstatus, round(exp(avg(ln(greatest(o_totalprice, 1e-6)))), 4) as geomean from orders group by o_orderstatus"),
    }
