"""Secret scans: credentials in one piece, and credentials in linked parts.

Strong kinds are reported wherever they stand.  Weak parts, that is account
names, key-like words and endpoints, are common in harmless text.  They are
reported only where parts that complete each other lie close together in one
scope (a block of text without an empty line): a key-like word with an account
or an endpoint, an account with a secret, an endpoint with a secret.  The join
of these intervals is a search by start in lists that are sorted once, with the
furthest end so far in the scope beside each; so it costs n log n, also in very
long texts, and emits each part once, however many partners it has.

Null text counts as empty and has no spans.  Spans of one kind never overlap;
those of several kinds may, and are listed by start and then by kind.  Each row
is judged by itself: repeated rows give repeated results, an empty table an
empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import schema_with
from rivulet.llm.common import map_batches, texts_of

#: The three strong kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts of a credential.
WEAK_KINDS = ("account", "key", "endpoint")
ACCOUNT = re.compile(r"""(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
KEY = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
ENDPOINT = re.compile(r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?:host|endpoint|bucket|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.I | re.A)
GAP = re.compile(r"\n[ \t\r]*\n")
#: Code points that two parts of one credential may lie apart.
REACH = 400

SPANS = "array<struct<kind:string,start:int,end:int>>"
Span = tuple[int, int, int]


def strong(text: str) -> list[Span]:
    """(start, rank of kind, end) of the strong kinds, sorted.

    The open-ended forms of the last two find the same spans as searching for
    any length and dropping short ones, since each takes a whole run.
    """
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def keylike(word: str) -> bool:
    """Whether a long word mixes small letters, capitals and digits as random keys do."""
    return any("a" <= c <= "z" for c in word) and any("A" <= c <= "Z" for c in word) and sum("0" <= c <= "9" for c in word) >= 2


class Parts:
    """Spans for the join: sorted starts, the scope of each, and the furthest end so far in it."""

    def __init__(self, spans: list[tuple[int, int]], gaps: list[int]) -> None:
        self.spans, self.gaps = sorted(spans), gaps
        self.starts = [s for s, _ in self.spans]
        self.ends: list[int] = []
        scope = -1
        for s, e in self.spans:
            now = bisect_right(gaps, s)
            self.ends.append(max(e, self.ends[-1]) if now == scope else e)
            scope = now

    def meets(self, start: int, end: int) -> bool:
        """Whether a span lies in the scope of [start, end) and within REACH of it.  No span crosses a line, so none leaves its scope."""
        scope = bisect_right(self.gaps, start)
        last = bisect_right(self.starts, end + REACH)
        if scope < len(self.gaps):
            last = min(last, bisect_left(self.starts, self.gaps[scope]))
        return last > 0 and bisect_right(self.gaps, self.starts[last - 1]) == scope and self.ends[last - 1] >= start - REACH


def outside(matches, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the matches that overlap none of the sorted spans."""
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for m in matches:
        before = bisect_left(starts, m.end())
        if not before or furthest[before - 1] <= m.start():
            out.append((m.start(), m.end()))
    return out


def weak(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that complete each other, ranked after the strong kinds."""
    taken = sorted((s, e) for s, _, e in base)
    keys = outside((m for m in KEY.finditer(text) if keylike(m[0])), taken)
    if not keys and all(k == 1 for _, k, _ in base):
        return []
    accounts = outside(ACCOUNT.finditer(text), taken)
    ends = outside(ENDPOINT.finditer(text), taken)
    access = [(s, e) for s, k, e in base if k == 1]
    if not (accounts or ends or access):
        return []
    gaps = [m.start() for m in GAP.finditer(text)]
    secrets = Parts(keys + [(s, e) for s, k, e in base if k != 1], gaps)
    names = Parts(accounts + access + ends, gaps)
    return [(s, k, e) for k, parts, others in ((3, accounts, secrets), (4, keys, names), (5, ends, secrets)) for s, e in parts if others.meets(s, e)]


def find(text: str) -> list[Span]:
    """All spans of a text as (start, rank of kind, end), sorted; code points, end exclusive."""
    base = strong(text)
    return sorted(base + weak(text, base))


def scan(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """``docs`` with a column ``spans``: kind, start and end of every secret, sorted.

    One pass without a shuffle.  A column that is already named ``spans`` is replaced.
    """
    docs = docs.drop(spans)
    at = docs.columns.index(text)
    names = KINDS + WEAK_KINDS
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": names[k], "start": s, "end": e} for s, k, e in find(t)] for t in texts_of(b.column(at))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, spans])

    return map_batches(docs, batch, schema_with(docs, spans, SPANS))


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined; of the kinds given, or of all."""
    rows = F.col(spans) if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans give one mark.  Null stays null."""
    at = docs.columns.index(text)

    def clean(t: str) -> str:
        out, upto = [], 0
        for s, _, e in find(t):
            if s >= upto:
                out += [t[upto:s], mark]
            upto = max(upto, e)
        return "".join(out) + t[upto:] if out else t

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else clean(t) for t in b.column(at).to_pylist()]
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_batches(docs, batch, docs.schema)
