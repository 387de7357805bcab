"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most three of 64 bits differ in at most one bit
of one half of 31 bits (or, with no more, in none).  The anchors of a half are
the codewords of the perfect Hamming code of length 31, whose covering radius
is one.  Each fingerprint has the one anchor within that radius as its home and
is also sent to all anchors within covering radius plus one (16 at most), so
two linked fingerprints meet: one at home, the other as a visitor.  At an
anchor, homes are compared with visitors.  There are 2**26 anchors a half, so
few strangers meet.

Equal fingerprints are one class, compared once.  An anchor that is the home of
more than ``crowd`` classes is split: of the other bits, cut into four parts,
linked fingerprints agree in one, so they meet again under (anchor, part,
value).  No pair is lost, and none is cut off.

Homes and visitors are far larger than the classes they are made of, by whose
size Spark would choose to broadcast them, so joins are told to deal them out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import schema_with
from rivulet.llm.common import BROADCAST_ROWS, FEW, dealt, fresh, map_batches, small, spool, texts_of
from rivulet.llm.components import components

#: Shingles whose bits are counted at a time, so that a long text needs no more memory.
CHUNK = 1 << 16
#: Classes at home at an anchor beyond which it is split.
CROWD = 512
LENGTH, HALF = 31, (1 << 31) - 1


def tally(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text: word shingles, letters A-Z made small, XXH64 with seed 42; no words give zero."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        ones += tally(np.fromiter((digest(s, 42) for s in part), dtype="<u8", count=len(part)))
    return majority(ones, len(shingles))


def fingerprints(docs: DataFrame, text: str = "text", fp: str = "fp", words: int = 3) -> DataFrame:
    """``docs`` with a column ``fp`` (bigint, the 64 bits).  Null text has no words and so fingerprint zero."""
    docs = docs.drop(fp)
    at = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, words) for t in texts_of(b.column(at))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(bits)], names=[*b.schema.names, fp])

    return map_batches(docs, batch, schema_with(docs, fp, "bigint"))


def halves(fp: Column) -> Column:
    """Half number and bits of both halves."""
    return F.array(*(F.struct(F.lit(i).cast("long").alias("half"), F.shiftrightunsigned(fp, 32 * i).bitwiseAND(F.lit(HALF)).alias("x")) for i in (0, 1)))


def syndrome(x: Column) -> Column:
    """The position (1 to 31) of the bit that takes ``x`` to its nearest codeword; 0 for a codeword."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (j - 1) for j in range(1, LENGTH + 1) if j >> k & 1)
        out = out + F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(mask))) % 2, k)
    return out.cast("int")


def anchored(classes: DataFrame, visiting: bool) -> DataFrame:
    """(key, fp) of each fingerprint's home anchors, or of all anchors that it visits, home included."""
    rows = classes.select("fp", F.explode(halves(F.col("fp"))).alias("h")).select("fp", "h.half", "h.x").withColumn("s", syndrome(F.col("x")))
    home = "if(s = 0, x, x ^ shiftleft(1L, s - 1))"
    places = f"array({home})"
    if visiting:
        pairs = f"filter(sequence(1, {LENGTH}), j -> s > 0 and j < (j ^ s))"
        places = f"concat({places}, transform({pairs}, j -> x ^ shiftleft(1L, j - 1) ^ shiftleft(1L, (j ^ s) - 1)))"
    return rows.select("fp", F.explode(F.expr(places)).alias("anchor"), "half").select(F.expr("shiftleft(half, 32) | anchor").alias("key"), "fp")


def parted(rows: DataFrame) -> DataFrame:
    """Rows once for each of the four parts of the bits outside the anchor's half."""
    other = F.expr("if(shiftrightunsigned(key, 32) = 0, shiftrightunsigned(fp, 31), (fp & 4294967295L) | shiftleft(shiftrightunsigned(fp, 63), 32))")
    return rows.select("key", "fp", other.alias("o")).select("key", "fp", F.posexplode(F.array(*(F.shiftright("o", 8 * i).bitwiseAND(F.lit(255 if i < 3 else 511)) for i in range(4))))).withColumnsRenamed({"pos": "part", "col": "value"})


def links(classes: DataFrame, threshold: int = 3, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (a, b) of different fingerprints that differ in at most ``threshold`` bits (3 at most)."""
    if not 0 <= threshold <= 3:
        raise ValueError("halves whose anchors lie one bit apart cover thresholds up to 3")
    classes = classes.select("fp")
    home, visit = anchored(classes, False), anchored(classes, True)
    close = F.expr(f"h.fp != v.fp and bit_count(h.fp ^ v.fp) <= {threshold}")
    crowded = spool(home.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    parts = []
    if crowded.limit(1).count():
        hot = small(crowded)
        keys = ["key", "part", "value"]
        h, v = parted(home.join(hot, "key", "left_semi")).alias("h"), parted(visit.join(hot, "key", "left_semi")).alias("v")
        parts.append(h.join(dealt(v), [*(F.col(f"h.{k}") == F.col(f"v.{k}") for k in keys), close]))
        home, visit = home.join(hot, "key", "left_anti"), visit.join(hot, "key", "left_anti")
    parts.append(home.alias("h").join(dealt(visit.alias("v")), [F.col("h.key") == F.col("v.key"), close]))
    pairs = [p.select(F.least("h.fp", "v.fp").alias("a"), F.greatest("h.fp", "v.fp").alias("b")) for p in parts]
    return (pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id, label) of every row.

    component_id is the smallest doc_id reachable over links, the row's own
    included.  Rows with a null doc_id get the component's id like any other;
    it is null only if all ids of the component are.  label names the component
    whatever its ids.
    """
    rows = spool(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words).drop("text"), "fingerprints")
    return grouped(rows, lambda classes: links(classes, threshold, crowd))


def grouped(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id, label) of rows (doc_id, fp); ``link`` gives the pairs (a, b) of linked classes (fp, first)."""
    classes = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(link(classes))
    of = classes.join(small(labels, FEW), classes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    known = spool(of.join(dealt(least), "label").select("fp", "component_id", "label"), "components")
    return rows.join(small(known, FEW), "fp").select("doc_id", "fp", "component_id", "label")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest doc_id.

    Rows are told apart by id and fingerprint, so of rows that repeat an id with
    different texts each counts in its own group; of those of one group that
    have its smallest id the one with the least fingerprint stays, and of equal
    ones one.  A row without an id stays only if its whole group has none.
    """
    return keep_first(docs, spool(near_duplicates(docs, doc_id, text, **options), "near"), lambda d, column: fingerprints(d, text, column), doc_id, broadcast_rows)


def keep_first(docs: DataFrame, found: DataFrame, marked: Callable[[DataFrame, str], DataFrame], doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that ``deduplicate`` keeps, given a spooled table (doc_id, fp, component_id, label); ``marked`` adds fp to documents, in a column of the given name.

    Ids alone decide about rows whose id no other row has; they are broadcast up
    to ``broadcast_rows``, and beyond that the join deals documents by id.  Texts
    are looked at again only where ids repeat or lack.
    """
    known = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"))
    odd = spool(known.where("n > 1 or gone"), "gone")
    kept = docs.where(F.col(doc_id).isNotNull()).join(small(odd.select(doc_id), broadcast_rows), doc_id, "left_anti").select(*docs.columns)
    again, none = odd.where("n > 1").select(doc_id), found.where("doc_id is null").limit(1).count() > 0
    if not none and not again.limit(1).count():
        return kept
    unclear = docs.where(F.col(doc_id).isNotNull()).join(small(again, broadcast_rows), doc_id, "left_semi").select(*docs.columns)
    if none:
        unclear = unclear.unionByName(docs.where(F.col(doc_id).isNull()))
    first = found.where("doc_id <=> component_id").groupBy("doc_id", "label").agg(F.min("fp").alias("fp"))
    first = first.join(small(again.select(F.col(doc_id).alias("doc_id")), broadcast_rows), "doc_id", "left_semi").unionByName(first.where("doc_id is null")).toDF("i", "label", "f")
    mark = fresh(docs, "fp")
    rows = marked(unclear, mark).dropDuplicates([doc_id, mark])
    chosen = rows.join(first.select("i", "f").distinct(), F.col(doc_id).eqNullSafe(F.col("i")) & (F.col(mark) == F.col("f")), "left_semi")
    return kept.unionByName(chosen.select(*docs.columns))
