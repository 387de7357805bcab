"""Quality rules of single documents, and of the hosts that they come from.

Every document is measured once.  Each rule's failures are summed by host; a
host's rate is shrunk towards the rate of all hosts with a beta prior fitted to
them by moments, so that a host with few documents is not judged by chance; a
host whose shrunk rate passes the limit for any rule is rejected with all its
documents.  Hosts, also one with a third of all rows, are summed before the
shuffle, and verdicts go back by broadcast if they are few.

Null text has no words and fails.  Null hosts are judged by their own
documents' rules alone.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import map_batches, small, spool, texts_of

#: White space between words, and symbols.
WHITE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HAS_WORD = re.compile(rf"[^{WHITE}]")
#: A host fails if its shrunk rate of a rule's failures is above this.
HOST_LIMIT = 0.5


def repeated(words: list[bytes], length: int = 3) -> int:
    """Words that stand in windows found twice or more in the text."""
    if len(words) <= length:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    _, key = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)
    _, at, n = np.unique(key * len(known) + ids[2:], return_inverse=True, return_counts=True)
    places = np.flatnonzero(n[at] > 1)
    hit = np.zeros(len(words), dtype=bool)
    for k in range(length):
        hit[places + k] = True
    return int(hit.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words and the four measures of a text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if HAS_WORD.search(x)]
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


#: Rules: a document fails where the condition holds.  Symbols and word lengths as in published web-corpus filters.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "lines": "n_words > 0 and 20 * n_dup_lines > n_words",
}
BASE = ("short", "repeats")


def measured(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, host, n_words and the measures of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    names = ["n_words", *MEASURES]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([measure(t) for t in texts_of(b.column(2))], dtype=np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(found[:, i]) for i in range(5))], names=["doc_id", "host", *names])

    kinds = dict(rows.dtypes)
    return map_batches(rows, batch, f"doc_id {kinds['doc_id']}, host {kinds['host']}, " + ", ".join(f"{n} bigint" for n in names))


def beta_prior(n: Column, failed: Column) -> tuple[Column, Column]:
    """Mean of the hosts' rates, and the prior's strength (as if so many documents), by weighted moments.

    What rates differ beyond the chance of counts of their size is the spread of
    the prior: the wider it is, the fewer documents it weighs.
    """
    total, hosts = F.sum(n), F.count(n)
    mean = F.sum(failed) / total
    spread = F.sum(failed * failed / n) / total - mean * mean - mean * (1 - mean) * hosts / total
    return mean, F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1))


def host_rates(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """host, n and the shrunk rate of each rule; one row for each host that is not null."""
    fails = [F.sum(F.expr(cond).cast("double")).alias(r) for r, cond in rules.items()]
    hosts = spool(docs.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *fails), "hosts")
    moments = hosts.agg(*(x.alias(f"{k}_{r}") for r in rules for k, x in zip("ms", beta_prior(F.col("n"), F.col(r)), strict=True))).first()
    shrunk = [((F.col(r) + moments[f"m_{r}"] * moments[f"s_{r}"]) / (F.col("n") + moments[f"s_{r}"])).alias(r) for r in rules if moments[f"m_{r}"] is not None]
    return hosts.select("host", "n", *shrunk)


def judge(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", limit: float = HOST_LIMIT, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """Every document's measures, base_failed, host_failed and kept."""
    rows = spool(measured(docs, host, doc_id, text), "measured")
    rates = host_rates(rows, rules)
    bad = [F.col(r) > limit for r in rates.columns if r in rules]
    failed = rates.where(reduce(Column.__or__, bad, F.lit(False))).select("host")
    failed = spool(failed, "failed-hosts").withColumn("host_failed", F.lit(True))
    base_failed = F.expr(" or ".join(f"({rules[r]})" for r in base))
    return (
        rows.join(small(failed), "host", "left")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )
