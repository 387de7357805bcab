"""Partition tokens, and predicates on partitions that reach the Parquet scan.

A token is ``v`` and the partition's value as text, ``n`` for the null
partition, or ``a`` for a table without partitions, so no value can be mistaken
for a mark.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

ALL, NULL = "a", "n"
DAY = re.compile(r"^\s*(?:to_date|date)\(\s*`?(\w+)`?\s*\)\s*$|^\s*cast\(\s*`?(\w+)`?\s+as\s+date\s*\)\s*$", re.I)


def token(value: object) -> str:
    return NULL if value is None else f"v{value}"


def value(tok: str) -> str | None:
    return None if tok == NULL else tok[1:]


def day_ranges(days: list[date]) -> list[tuple[date, date]]:
    """Half-open ranges of neighbouring days."""
    out: list[tuple[date, date]] = []
    for d in sorted(set(days)):
        if out and out[-1][1] == d:
            out[-1] = (out[-1][0], d + timedelta(days=1))
        else:
            out.append((d, d + timedelta(days=1)))
    return out


def in_partitions(df: DataFrame, expr: str, tokens: set[str]) -> Column:
    """Whether a row's partition, by ``expr``, is one of the tokens.

    Days of a timestamp become half-open ranges of the column itself, which the
    scan can use; other values become typed literals.
    """
    if ALL in tokens:
        return F.lit(True)
    values = sorted(value(t) for t in tokens if t != NULL)
    kind = df.select(F.expr(expr).alias("p")).schema[0].dataType
    day = DAY.match(expr)
    column = (day[1] or day[2]) if day else None
    by_range = column in df.columns and isinstance(kind, DateType) and isinstance(df.schema[column].dataType, (TimestampType, TimestampNTZType))
    found = [F.col(column).isNull() if by_range else F.expr(expr).isNull()] if NULL in tokens else []
    if by_range:
        of = df.schema[column].dataType
        found += [(F.col(column) >= F.lit(a.isoformat()).cast(of)) & (F.col(column) < F.lit(b.isoformat()).cast(of)) for a, b in day_ranges([date.fromisoformat(v) for v in values])]
    elif values:
        found.append(F.expr(expr).isin(*[F.lit(v).cast(kind) for v in values]))
    return reduce(Column.__or__, found, F.lit(False))


def row_hash(columns: list[str]) -> Column:
    """A 64-bit hash of a row; null flags go in too, since nulls alone do not move the hash."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]) if columns else F.lit(0).cast("long")


def table_hash(columns: list[str]) -> Column:
    """A hash of a set of rows that does not depend on their order; repeated rows count."""
    return F.sum(row_hash(columns).cast("decimal(38,0)")).cast("string")
