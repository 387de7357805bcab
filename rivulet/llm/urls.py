"""URL filters: domain rules first, then a character language model.

Rules name a domain and the beginning of a path; they fit the domain's
subdomains, and the longest one that fits decides.  The URLs that rules decide
train two models of characters (bytes of UTF-8), one of accepted and one of
rejected URLs.  Both are Markov models of variable order: the estimate of each
order is smoothed towards the next lower one, by how often the context was seen.
A URL without a rule is rejected if its log-likelihood difference per character
is below a limit.

What a model says of a character depends on the window of ORDERS bytes that ends
there.  A window is kept whole as an integer, so counts are exact, and there are
as many as the URLs have different windows: they stay a table, which is joined.
Equal URLs are counted and scored once, with their number.  The limit is set on
URLs of every FOLDS-th hash, scored by models of the others alone; the models
that judge count all.

Null URLs, and those without ``://``, have an empty host and path and no
characters; their difference is 0.  Without URLs of both kinds no limit can be
set, and all others are allowed; if only the held-out ones lack a kind, the limit
is set on all.  Pages that repeat are judged alike, and each is a row of the
result.  Very long URLs are taken whole.  An empty table gives none, and columns
of other names play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import passing, spool

#: Bytes of a window: a character and what stands before it (at most 7).
ORDERS = 5
#: How many sightings of a context the next lower order counts for.
BACKING = 2.0
#: Bins of the log-likelihood difference for the calibration.
BIN = 64
#: One URL of so many is held out for the limit.
FOLDS = 5
#: Log-likelihoods are summed in whole parts of this size, so that no order of addition matters.
PART = 1e-9

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z made small) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), CAPITALS, SMALL), F.regexp_extract(url, PARTS, 2)


def fitting(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null; of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        domain, slash, rest = rule.partition("/")
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        out = F.when(fits & F.startswith(path, F.lit(slash + rest)), F.lit(rule)).otherwise(out)
    return out


def windows(urls: DataFrame) -> DataFrame:
    """``urls`` with a row for each byte of ``of``: the window that ends there, as an integer; ``padded`` is ``of`` with zeros before it."""
    ends = f"filter(sequence(1, octet_length(padded) - {ORDERS - 1}), i -> octet_length(padded) >= {ORDERS})"
    return urls.withColumn("window", F.explode(F.expr(f"transform({ends}, i -> cast(conv(hex(substring(padded, i, {ORDERS})), 16, 10) as bigint))"))).drop("padded", "of")


def padded() -> Column:
    return F.expr(f"concat(unhex('{'00' * (ORDERS - 1)}'), encode(of, 'UTF-8'))")


def model(counts: DataFrame) -> DataFrame:
    """(window, whole, part): accepted less rejected log-likelihood of each window, in units of PART.

    ``counts`` has for each window how often URLs of each kind (0 rejected, 1
    accepted) have it: n0 and n1 of all, m0 and m1 of those not held out.
    ``whole`` is by the former, ``part`` by the latter.
    """
    names = ("n0", "n1", "m0", "m1")
    sums = lambda df, key: df.groupBy(key).agg(*(F.sum(c).alias(c) for c in names))
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    out = counts.select("window")
    bounded = lambda df, bytes_: F.broadcast(df) if bytes_ <= 2 else df  # noqa: E731 - 65,536 rows at most
    for k in range(ORDERS):
        end = F.col("window").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        seen = sums(counts.withColumn(f"end{k}", end), f"end{k}")
        if k:
            before = sums(seen.withColumn(f"before{k}", F.shiftright(f"end{k}", 8)), f"before{k}")
            out = out.withColumn(f"before{k}", F.shiftright(end, 8)).join(bounded(before.withColumnsRenamed({c: f"c{c}" for c in names}), k), f"before{k}")
        out = out.withColumn(f"end{k}", end).join(bounded(seen, k + 1), f"end{k}")
        p = lambda c, k=k: (F.col(c) + BACKING * F.col(f"p{c}")) / (F.col(f"c{c}") + BACKING) if k else (F.col(c) + 0.5) / F.lit(total[c] + 128.0)
        out = out.select("window", *(p(c).alias(f"p{c}") for c in names))
    says = lambda c: F.round((F.log(f"p{c}1") - F.log(f"p{c}0")) / PART).cast("long")
    return out.select("window", says("n").alias("whole"), says("m").alias("part"))


def differences(urls: DataFrame) -> DataFrame:
    """(a, b, difference, trial) of distinct URLs (of, padded, kind, n), a and b hashes of ``of``; those without characters are left out.

    kind is null, 0 or 1 and n the number of rows.  ``trial`` is the difference
    by models that have not seen the held-out URLs.
    """
    rows = windows(urls.select(*keys(), "kind", "n", "padded"))
    of = lambda kind, also: F.sum(F.when((F.col("kind") == kind) & also, F.col("n")).otherwise(0))
    fit = ~held_out()
    with passing(urls.sparkSession) as result:
        counts = spool(rows.groupBy("window").agg(of(0, F.lit(True)).alias("n0"), of(1, F.lit(True)).alias("n1"), of(0, fit).alias("m0"), of(1, fit).alias("m1")), "url-windows")
        said = spool(model(counts), "url-model")
        mean = lambda c: F.sum(c) * PART / F.count("*")
        return result(rows.join(said, "window").groupBy("a", "b").agg(mean("whole").alias("difference"), mean("part").alias("trial")), "url-differences")


def keys() -> list[Column]:
    return [F.xxhash64("of").alias("a"), F.xxhash64("of", F.lit(1)).alias("b")]


def held_out() -> Column:
    return F.pmod(F.col("b"), F.lit(FOLDS)) == 0


def calibrated(scored: DataFrame) -> float:
    """The limit with the best mean of both kinds' shares of right answers, over all rows of (kind, n, difference)."""
    # as many rows come back as there are bins
    bins = scored.groupBy("kind", F.floor(F.col("difference") * BIN).alias("bin")).agg(F.sum("n").alias("n")).collect()
    total = [sum(r["n"] for r in bins if r["kind"] == k) for k in (0, 1)]
    if not all(total):
        return -math.inf
    cuts = sorted({r["bin"] for r in bins} | {max(r["bin"] for r in bins) + 1})
    share = lambda cut: sum((r["bin"] >= cut) == (r["kind"] == 1) and r["n"] / total[r["kind"]] for r in bins)
    return max(cuts, key=lambda cut: (share(cut), -cut)) / BIN


def judge(pages: DataFrame, rules: dict[str, str], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, difference and verdict of every page; ``rules`` say block or allow."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting(F.col("host"), F.col("path"), rules)).withColumn("of", F.concat("host", "path"))
    says = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    with passing(pages.sparkSession) as result:
        urls = rows.groupBy("of", (says == "allow").cast("int").alias("kind")).agg(F.count("*").alias("n"))
        urls = spool(urls.withColumn("padded", padded()), "urls")
        found = differences(urls)
        known = urls.where("kind is not null").select("kind", "n", *keys()).join(found, ["a", "b"])
        trial, fallback = known.where(held_out()).select("kind", "n", F.col("trial").alias("difference")), known.select("kind", "n", "difference")
        both = trial.select("kind").distinct().count() == 2
        limit = calibrated(trial if both else fallback)
        found = result(found, "url-scores")
    scored = rows.select("*", *keys()).join(found.drop("trial"), ["a", "b"], "left").withColumn("difference", F.coalesce("difference", F.lit(0.0)))
    verdict = F.coalesce(says, F.when(F.col("difference") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", "difference", verdict.alias("verdict"))
