"""The incremental engine: signals in, smallest sound recomputation out.

The result always equals a full rebuild.  Sources are loaded as new versions;
what a load changed is found by comparing partition hashes in the manifest.  A
signal says that a source has changed.  A run takes settled signals in
dependency order and marks what they reach in each model; each marked model
then recomputes partitions, keys or all of itself, and only content that really
changed goes on to its own readers.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.predicates import ALL, in_partitions, token
from rivulet.plans.strategy import Strategy, analyze_edge, changed_outputs
from rivulet.plans.walker import bind
from rivulet.sources.models import Dag, Model
from rivulet.sources.warehouse import Warehouse

#: Rows of a key set that may be broadcast.
KEYS_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Policy:
    """When to wait, and when recomputing everything is cheaper."""

    settle: timedelta = timedelta(minutes=15)
    full_refresh_ratio: float = 0.25
    budget_seconds: float | None = None
    min_rows_for_cost_rules: int = 10_000
    cutoff: bool = True


@dataclass
class Report:
    steps: list[str] = field(default_factory=list)
    propagated: dict[str, list[str]] = field(default_factory=dict)
    deferred: dict[str, str] = field(default_factory=dict)


def nullsafe(left: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """Rows of ``left`` whose column is (left_semi) or isn't (left_anti) among the keys; null is a key like others."""
    k = keys.toDF("__key")
    return left.join(k, left[column].eqNullSafe(k["__key"]), how)


class Engine:
    def __init__(self, spark: SparkSession, models: Dag | list[Model] | dict[str, Model], root: str, policy: Policy = Policy()) -> None:
        self.spark, self.dag, self.policy = spark, models if isinstance(models, Dag) else Dag(models), policy
        self.store = Warehouse(spark, root)
        self._edges: dict[tuple[str, str], Strategy] = {}
        self._columns: dict[tuple, set[str] | None] = {}

    # state

    @property
    def dirty(self) -> list[dict]:
        return self.store.state["dirty"]

    def status(self) -> dict[str, list[str]]:
        """Open marks by model."""
        out: dict[str, list[str]] = {}
        for e in self.dirty:
            out.setdefault(e["model"], []).append(e["kind"] + (f":{e['parent']}" if e["parent"] else "") + (f":{e['token']}" if e["token"] else ""))
        return {k: sorted(v) for k, v in sorted(out.items())}

    def mark(self, model: str, kind: str, since: str, tok: str = "", parent: str = "", cols: list[str] | None = None, old: str | None = None) -> None:
        """Adds a mark; with one like it, the earlier time, all columns of both and the older state hold."""
        for e in self.dirty:
            if (e["model"], e["kind"], e["token"], e["parent"]) == (model, kind, tok, parent):
                e["since"] = min(e["since"], since)
                e["cols"] = None if e["cols"] is None or cols is None else sorted({*e["cols"], *cols})
                return
        self.dirty.append({"model": model, "kind": kind, "token": tok, "parent": parent, "since": since, "cols": cols, "old": old})

    def load(self, name: str, df: DataFrame, tokens: set[str] | None = None) -> set[str]:
        """New content of a source, or of the partitions given of it; returns the tokens that changed."""
        m, before = self.dag.models[name], dict(self.store.parts(name))
        if tokens is not None and m.partition_expr:
            df = df.where(in_partitions(df, m.partition_expr, tokens))
        new = self.store.write(name, df, m.partition_expr)
        parts = new if tokens is None else {t: p for t, p in before.items() if t not in tokens} | new
        same = self.store.has(name) and self.store.schema(name) == df.schema
        changed = differing(before, parts)
        # partitions with equal content keep their old folder
        parts = {t: before[t] if same and t in before and t not in changed else p for t, p in parts.items()}
        if self.store.has(name):
            pending = self.store.state["pending"].setdefault(name, {})
            for t in changed:
                pending.setdefault(t, before[t]["version"] if t in before and same else None)
        self.store.put(name, df.schema, parts)
        self.store.commit()
        self._edges.clear()
        self._columns.clear()
        return changed

    def signal(self, name: str, partitions: list | str = "ALL", at: datetime | None = None, columns: list[str] | None = None) -> None:
        """Says that partitions of a source have changed; ``columns`` limits it to updates in place of these."""
        since = (at or datetime.now()).isoformat()
        for t in [ALL] if partitions == "ALL" else [token(p) for p in partitions]:
            self.mark(name, "part", since, t, cols=columns)
        self.store.commit()

    def schemas(self) -> dict:
        return {n: self.store.schema(n) for n in self.store.state["tables"]}

    def edge(self, parent: str, child: str) -> Strategy:
        if (parent, child) not in self._edges:
            self._edges[parent, child] = analyze_edge(self.spark, self.dag.models[child], self.dag.models[parent], self.schemas())
        return self._edges[parent, child]

    # building

    def frame(self, name: str) -> DataFrame:
        return self.store.read(name)

    def sql_hash(self, m: Model) -> str:
        return hashlib.sha256(f"{m.sql}|{m.partition_expr}".encode()).hexdigest()[:16]

    def build(self, m: Model) -> None:
        df = bind(self.spark, m.sql, {d: self.frame(d) for d in m.deps})
        self.store.put(m.name, df.schema, self.store.write(m.name, df, m.partition_expr), self.sql_hash(m))

    def build_all(self) -> None:
        for n in self.dag.order:
            if not self.dag.models[n].source:
                self.build(self.dag.models[n])
        self.store.state["dirty"], self.store.state["pending"] = [], {}
        self.store.commit()

    # a run

    def run_once(self, now: datetime | None = None, policy: Policy | None = None) -> Report:
        """Works off what has settled; safe to repeat after a crash, since each step commits at once."""
        policy, now, report, began = policy or self.policy, now or datetime.now(), Report(), time.monotonic()
        for n in self.dag.order:
            m = self.dag.models[n]
            if not m.source and self.store.has(n) and self.store.state["tables"][n]["sql"] != self.sql_hash(m):
                self.mark(n, "all", now.isoformat())
        for n in self.dag.order:
            entries = [e for e in self.dirty if e["model"] == n]
            if not entries:
                continue
            if policy.budget_seconds is not None and time.monotonic() - began > policy.budget_seconds:
                report.deferred[n] = "time budget"
                continue
            if self.dag.models[n].source:
                ripe = [e for e in entries if datetime.fromisoformat(e["since"]) + policy.settle <= now]
                if len(ripe) < len(entries):
                    wake = min(datetime.fromisoformat(e["since"]) for e in entries if e not in ripe) + policy.settle
                    report.deferred[n] = f"settling until {wake.isoformat()}"
                if ripe:
                    self.spread_source(n, ripe, report)
            else:
                self.refresh(n, entries, policy, report)
        return report

    def spread_source(self, name: str, entries: list[dict], report: Report) -> None:
        """Signals of a source go on to its readers, together with what its loads changed."""
        parts = self.store.parts(name)
        pending = self.store.state["pending"].pop(name, {})
        tokens = {e["token"] for e in entries}
        named = set(parts) if ALL in tokens and self.dag.models[name].partition_expr else tokens
        # where loads have told what differs, a signal for everything means just that
        hit = dict(pending) if pending and ALL in tokens else {t: pending.get(t, parts[t]["version"] if t in parts and t not in pending else None) for t in named} | pending
        known = {t: v for t, v in hit.items() if t in pending}
        hit = {t: v if t in known else None for t, v in hit.items()}
        cols = None if any(e["cols"] is None for e in entries) else sorted({c for e in entries for c in e["cols"]})
        self.propagate(name, hit, min(e["since"] for e in entries), cols, report)
        self.store.state["dirty"] = [e for e in self.dirty if e not in entries]
        self.store.commit()

    def propagate(self, name: str, changed: dict[str, str | None], since: str, cols: list[str] | None, report: Report) -> None:
        """Marks in each reader what changed partitions reach.  ``changed`` has each token's version before, if known."""
        if not changed:
            return
        if self.dag.children(name):
            report.propagated[name] = sorted(changed)
        for c in self.dag.children(name):
            child, out = self.dag.models[c], None
            if not self.store.has(c):
                continue
            if cols is not None:
                out = self.relevant(c, name, cols)
                if out is not None and not out:
                    report.steps.append(f"{c}: no column that it reads has changed")
                    continue
            s, out = self.edge(name, c), None if out is None else sorted(out)
            if s.kind == "full":
                self.mark(c, "all", since, cols=out)
            elif s.kind in ("keyed", "outer_join"):
                for t, old in changed.items():
                    self.mark(c, "keys" if s.kind == "keyed" else "joinkeys", since, t, name, out, old)
            elif ALL in changed and not self.dag.models[name].partition_expr:
                rows = self.changed_rows(name, {ALL: changed[ALL]})
                self.mark_parts(c, since, out, self.targets(rows, s.parent_expr))
            elif s.kind == "aligned":
                self.mark_parts(c, since, out, set(changed))
            else:
                self.mark_parts(c, since, out, self.targets(self.changed_rows(name, changed), s.parent_expr))

    def mark_parts(self, model: str, since: str, cols: list[str] | None, tokens: set[str]) -> None:
        for t in sorted(tokens):
            self.mark(model, "part", since, t, cols=cols)

    def relevant(self, child: str, parent: str, cols: list[str]) -> set[str] | None:
        key = (child, parent, tuple(cols))
        if key not in self._columns:
            self._columns[key] = changed_outputs(self.spark, self.dag.models[child], parent, set(cols), self.schemas())
        return self._columns[key]

    def targets(self, rows: DataFrame, expr: str) -> set[str]:
        return {token(r[0]) for r in rows.select(F.expr(expr).cast("string")).distinct().collect()}

    def changed_rows(self, name: str, changed: dict[str, str | None]) -> DataFrame:
        """Rows that a table gained or lost in these partitions; where the state before isn't known, all rows there."""
        parts = self.store.parts(name)
        known = {t: v for t, v in changed.items() if v}
        new = self.store.read(name, tokens=set(known))
        old = self.store.read(name, {t: {"version": v} for t, v in known.items()})
        rows = [self.store.read(name, tokens=set(changed) - set(known))] if set(changed) - set(known) else []
        if known:
            rows += [new.exceptAll(old), old.exceptAll(new)] if set(known) & set(parts) else [old]
        return reduce(DataFrame.unionByName, rows)

    # refreshing

    def refresh(self, name: str, entries: list[dict], policy: Policy, report: Report) -> None:
        m, before = self.dag.models[name], dict(self.store.parts(name))
        kinds = {e["kind"] for e in entries}
        tokens = {e["token"] for e in entries if e["kind"] == "part"}
        big = self.store.rows(name) >= policy.min_rows_for_cost_rules
        why = "all of it is marked" if "all" in kinds or ALL in tokens else ""
        if not why and big and len(tokens) > policy.full_refresh_ratio * max(1, len(before)):
            why = f"{len(tokens)} of {len(before)} partitions are marked"
        other = bind(self.spark, m.sql, {d: self.frame(d) for d in m.deps}).schema.simpleString() != self.store.schema(name).simpleString()
        if other and not why:
            why = "its columns have changed"
        parts, keys = before, {}
        if not why:
            for parent in sorted({e["parent"] for e in entries if e["kind"] in ("keys", "joinkeys")}):
                s = self.edge(parent, name)
                if s.kind not in ("keyed", "outer_join"):
                    why = f"edge from {parent} is {s.kind} now"
                    break
                marked = {e["token"]: e["old"] for e in entries if e["parent"] == parent}
                rows = self.changed_rows(parent, marked).select(F.col(s.key_col).alias("k")).distinct().cache()
                n = rows.count()
                keys[parent] = s, F.broadcast(rows) if n <= KEYS_BROADCAST else rows, n
                if big and n > policy.full_refresh_ratio * self.store.rows(name):
                    why = f"{n} keys have changed"
                    break
        if why:
            df = bind(self.spark, m.sql, {d: self.frame(d) for d in m.deps})
            parts = self.store.write(name, df, m.partition_expr)
            self.store.put(name, df.schema, parts, self.sql_hash(m))
            report.steps.append(f"{name}: rebuilt, since {why}")
        else:
            for parent, (s, k, n) in keys.items():
                if s.kind == "outer_join" and s.mode == "partition":
                    tokens |= self.targets(nullsafe(self.frame(s.preserved), k, s.preserved_key, "left_semi"), s.parent_expr)
            if tokens:
                parts = self.by_partition(m, tokens, parts)
                report.steps.append(f"{name}: {len(tokens)} partitions")
            for parent, (s, k, n) in keys.items():
                if s.mode != "partition" and n:
                    parts = self.by_key(m, parent if s.kind == "keyed" else s.preserved, s.key_col if s.kind == "keyed" else s.preserved_key, s.key_out, k, parts)
                    report.steps.append(f"{name}: {n} keys of {parent}")
            self.store.put(name, self.store.schema(name), parts, self.sql_hash(m))
        changed = differing(before, parts) if policy.cutoff else {*before, *parts} if why else differing(before, parts) | tokens
        since, cols = min(e["since"] for e in entries), None if any(e["cols"] is None for e in entries) or why else sorted({c for e in entries for c in e["cols"]})
        self.store.state["dirty"] = [e for e in self.dirty if e not in entries]
        if other:
            # rows before and now do not compare: readers are recomputed whole, and so see the columns
            report.propagated[name] = sorted(changed)
            for c in self.dag.children(name):
                if self.store.has(c):
                    self.mark(c, "all", since)
        else:
            self.propagate(name, {t: before[t]["version"] if t in before else None for t in changed}, since, cols, report)
        self.store.commit()
        for _, k, _ in keys.values():
            k.unpersist()

    def by_partition(self, m: Model, tokens: set[str], parts: dict[str, dict]) -> dict[str, dict]:
        """Recomputes partitions; inputs whose partitions they follow from are cut down to what these need."""
        inputs = {}
        for d in m.deps:
            s, df = self.edge(d, m.name), self.frame(d)
            inputs[d] = df.where(in_partitions(df, s.parent_expr, tokens)) if s.kind in ("aligned", "data_dependent") else df
            if s.kind == "aligned":
                inputs[d] = self.store.read(d, tokens=tokens).where(in_partitions(df, s.parent_expr, tokens))
        df = bind(self.spark, m.sql, inputs)
        new = self.store.write(m.name, df.where(in_partitions(df, m.partition_expr, tokens)), m.partition_expr)
        return settled({t: p for t, p in parts.items() if t not in tokens} | new, parts)

    def by_key(self, m: Model, cut: str, key: str, out: str, keys: DataFrame, parts: dict[str, dict]) -> dict[str, dict]:
        """Recomputes all rows of the keys from the inputs cut down to them, and replaces them wherever they were."""
        inputs = {d: nullsafe(self.frame(d), keys, key, "left_semi") if d == cut else self.frame(d) for d in m.deps}
        fresh = bind(self.spark, m.sql, inputs)
        current = self.store.read(m.name, parts)
        part = (lambda df: df.select(F.expr(m.partition_expr).cast("string"))) if m.partition_expr else None
        gone = nullsafe(current, keys, out, "left_semi")
        touched = {token(r[0]) for r in part(gone).union(part(fresh)).distinct().collect()} if part else {ALL}
        kept = nullsafe(self.store.read(m.name, parts, touched), keys, out, "left_anti")
        new = self.store.write(m.name, kept.unionByName(fresh), m.partition_expr)
        return settled({t: p for t, p in parts.items() if t not in touched} | new, parts)

    def on_change(self, name: str, partitions: list | str = "ALL", columns: list[str] | None = None) -> Report:
        """A signal and a run at once."""
        now = datetime.now()
        self.signal(name, partitions, now - self.policy.settle, columns)
        return self.run_once(now)

    # telling

    def explain(self) -> list[tuple[str, str, Strategy]]:
        return [(p, n, self.edge(p, n)) for n in self.dag.order for p in self.dag.models[n].deps]

    def check(self) -> str:
        """A line for each edge, with advice where a change means a rebuild."""
        out = []
        for p, n, s in self.explain():
            line = f"{p} -> {n}: {s.kind}"
            if s.kind != "full" and not self.dag.models[p].partition_expr:
                line += f"; {p} has no partitions: declare some, so that changes are told apart"
            if s.kind == "full":
                tip = next((t for k, t in ADVICE.items() if k in s.reason), "")
                line += f" ({s.reason})" + (f"; {tip}" if tip else "")
            out.append(line)
        return "\n".join(out)


#: What to do about a reason for rebuilding.
ADVICE = {
    "unpartitioned": "give the model a partition",
    "GROUP BY": "group by the partition or by one selected key",
    "window function": "partition the window by the partition or by one selected key",
    "LIMIT": "use row_number() by key and a filter",
    "nullable side": "join by one equality in a plain SELECT",
    "more than once": "read the input once",
    "subquery expression": "use a join, or a model of its own",
    "cannot resolve partition": "select the partition column straight from the input",
    "global aggregate": "group by a key or the partition",
    "depends on columns outside": "take the partition from the input that changes",
}


def differing(before: dict[str, dict], after: dict[str, dict]) -> set[str]:
    """Tokens whose content differs."""
    same = {t for t in before.keys() & after.keys() if (before[t]["rows"], before[t]["hash"]) == (after[t]["rows"], after[t]["hash"])}
    return (before.keys() | after.keys()) - same


def settled(after: dict[str, dict], before: dict[str, dict]) -> dict[str, dict]:
    """Partitions with their old folder where the content is the same."""
    changed = differing(before, after)
    return {t: p if t in changed else before[t] for t, p in after.items()}
