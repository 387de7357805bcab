"""Near-duplicates by Jaccard similarity of word shingles, none lost.

A text is the set of its five-word shingles, as XXH64 hashes; two texts are
linked if their sets have a similarity of 0.8 or more.  Candidates come first from
SimHash: fingerprints of the sets meet at ``simhash``'s anchors, and each is compared
with the smallest that it is linked to, and with its like.  What the whole sets confirm
is one group from then on.  Sets so similar differ in some ten bits, though, and three is all that
anchors reach, so what is still in different groups is completed by
prefixes: with all shingles in one fixed order, two sets so similar share one
among the first fifth (and one more) of each, and at the first that they share
neither set may have passed so many others that the rest cannot suffice.  The
order puts shingles of busy slots last; the slots serve the order alone, and any
order finds all pairs.  Candidates whose sketches differ in more bits than
similar sets can are left out as they meet, which loses none either.  Those sketches are too
narrow for long texts, so the others are compared by wider ones that grow with the text, and what
these allow is decided by the whole sets.

Thousands of texts alike would be millions of pairs.  So at each shared shingle
the texts of different groups are first compared with two of them, its leaders; what that links is
one group.  Further rounds do the same among those in different groups, with
other leaders, as long as there are many pairs of them and the last round linked
some.  Then all pairs are compared that share a shingle and are still in
different groups, however many.  The groups are those of all links, but pairs
within a group are not listed.  Tables in between are deleted when they are spent.

Words are those of ``simhash.fingerprint``: letters A-Z made small, cut at
whitespace.  Texts with fewer than five words are one shingle; null, empty and
blank texts have none and are all equal.  Texts with equal sets are one class,
compared once.  Very long texts are taken whole, one at a time.  Of rows that
repeat an id each is judged by its own text.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import simhash
from rivulet.llm.bpe import schema_with
from rivulet.llm.common import BROADCAST_ROWS, FEW, arrow_limits, dealt, list_array, map_batches, passing, small, spool, texts_of
from rivulet.llm.components import components

#: Words of a shingle; linked are sets with a similarity of PARTS / (PARTS + 1) or more.
WORDS, PARTS = 5, 4
#: Slots of the counts that order shingles, and bits of a sketch (powers of two).
SLOTS, BITS = 1 << 21, 512
#: A slot is busy in a task from so many times the mean count on, and from this count on.
BUSY, LEAST_BUSY = 4, 3
#: Leaders of each shared shingle in a round of comparisons with them.
STARS = 2
#: Rounds go on while there are more pairs in different groups than this times the meetings; this many at most, the rest are compared as pairs.
PAIRS, ROUNDS = 1, 2


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, dtype=np.int64)
    parts = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in parts), dtype=np.uint64, count=len(parts))).view(np.int64)


def key(hashes: np.ndarray) -> int:
    """The key of a class: a hash of the whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def keyed(docs: DataFrame, text: str, column: str) -> DataFrame:
    """``docs`` with the key of each text's class."""
    docs = docs.drop(column)
    at = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([key(shingles(t)) for t in texts_of(b.column(at))], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, column])

    return map_batches(docs, batch, schema_with(docs, column, "bigint"))


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of 64-bit integers."""
    return list_array(np.concatenate([np.empty(0, dtype=np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int64())


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set."""
    return int(np.uint64(simhash.majority(simhash.tally(hashes), len(hashes))).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether each of BITS parts holds an odd number of the set's hashes.

    Two sketches differ in no more bits than the sets differ in hashes.
    """
    odd = np.bincount(hashes.view(np.uint64) >> np.uint64(64 - BITS.bit_length() + 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(hashes: np.ndarray) -> np.ndarray:
    """As ``sketch``, but with two bits or more for each hash; half of a wider one, added to its other half, is the narrower one."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(fp, hashes) of the classes of all rows; fp is a class's key.

    It hashes texts anew whenever it is read: hashes of whole tables take more
    room than the texts, and do not compress.  A class comes once a batch.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = {key(h): h for h in map(shingles, texts_of(b.column(0)))}
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), lists(list(found.values()))], names=["fp", "hashes"])

    return map_batches(docs.select(text), batch, "fp bigint, hashes array<bigint>")


def slots(hashes: np.ndarray) -> np.ndarray:
    return hashes & (SLOTS - 1)


def busy(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many rows have a shingle in each slot that is busy in some task; 0 for the others."""
    arrow_limits(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.int32)
        for b in batches:
            for t in texts_of(b.column(0)):
                table[slots(shingles(t))] += 1
        at = np.flatnonzero(table >= max(LEAST_BUSY, BUSY * table.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], names=["slot", "n"])

    got = docs.select(text).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, dtype=np.int64)
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    return table


def outlines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, n, simhash, sketch, wide, first) of every row: its class, the size, SimHash and sketches of its set and the shingles of its prefix, in order.

    A class's SimHash, sketches and prefix come once a batch; its other rows there have none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(busy(docs, text))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        table, known, keys, sizes, prints, marks, wide, first = sent.value, set(), [], [], [], [], [], []
        for h in map(shingles, texts_of(b.column(1))):
            keys.append(key(h))
            sizes.append(len(h))
            long = 0 if keys[-1] in known or not len(h) else len(h) // (PARTS + 1) + 1
            first.append(h[np.lexsort((h, table[slots(h)]))[:long]] if long else h[:0])
            prints.append(fingerprint(h) if long else None)
            marks.append(sketch(h) if long else h[:0])
            wide.append(wide_sketch(h) if long else h[:0])
            known.add(keys[-1])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists(marks), lists(wide), lists(first)], names=["doc_id", "fp", "n", "simhash", "sketch", "wide", "first"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, batch, f"doc_id {kind}, fp bigint, n bigint, simhash bigint, sketch array<bigint>, wide array<bigint>, first array<bigint>")


def meetings(rows: DataFrame) -> DataFrame:
    """(fp, n, sketch, at, hash) of the classes that share a shingle of their prefixes with another class; ``at`` is its place there."""
    first = rows.select("fp", F.posexplode("first").alias("at", "hash"))
    of = rows.where(F.size("first") > 0).select("fp", "n", "sketch").dropDuplicates(["fp"])
    with passing(rows.sparkSession) as result:
        shared = spool(first.groupBy("hash").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("hash"), "shared")
        places = spool(first.join(small(shared, FEW), "hash", "left_semi").distinct(), "places")
        return result(places.join(of, "fp").select("fp", "n", "sketch", "at", "hash"), "met")


def close(x: str, y: str) -> Column:
    """Whether sets that first meet at these places, with these sketches, may be similar."""
    places = f"{2 * PARTS + 1} * least({x}.n - {x}.at, {y}.n - {y}.at) >= {PARTS} * ({x}.n + {y}.n)"
    differ = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(BITS // 64))
    return F.expr(f"{places} and {2 * PARTS + 1} * ({differ}) <= {x}.n + {y}.n")


def alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose wide sketches differ in no more bits than similar sets can."""
    ends = spool(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "ends")
    wide = rows.where(F.size("wide") > 0).select("fp", "n", "wide").join(small(ends, FEW), "fp", "left_semi").dropDuplicates(["fp"])
    wide = spool(wide, "wide")
    sides = pairs.join(wide.toDF("a", "m", "left"), "a").join(wide.toDF("b", "n", "right"), "b")
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    left = F.expr(f"case when size(left) = 2 * size(right) then {half.format('left')} else left end")
    right = F.expr(f"case when size(right) = 2 * size(left) then {half.format('right')} else right end")
    sides = sides.select("a", "b", "m", "n", left.alias("left"), right.alias("right"))
    differ = "aggregate(zip_with(left, right, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"
    return sides.where(f"size(left) != size(right) or {2 * PARTS + 1} * {differ} <= m + n").select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(a, b) of those of the pairs (x, y) whose whole sets are similar, a being the smaller; ``rows`` are the outlines of ``docs``."""
    with passing(docs.sparkSession) as result:
        some = spool(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        some = spool(alike(some, rows), "alike")
        ends = spool(some.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "ends")
        whole = spool(sets(docs, text).join(small(ends, FEW), "fp", "left_semi").dropDuplicates(["fp"]), "whole")
        sides = some.join(whole.toDF("a", "left"), "a").join(whole.toDF("b", "right"), "b")
        counted = sides.select("a", "b", (F.size("left") + F.size("right")).alias("all"), F.size(F.array_intersect("left", "right")).alias("same"))
        return result(counted.where(f"{2 * PARTS + 1} * same >= {PARTS} * all").select("a", "b"), "links")


def by_simhash(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) of similar classes with linked fingerprints, as many as there are classes at most.

    Of each fingerprint the smallest class stands for all.  The others are
    compared with it, and it with that of the smallest fingerprint linked to its own.
    """
    with passing(docs.sparkSession) as result:
        of = spool(rows.where("simhash is not null").select("fp", "simhash").distinct(), "simhashes")
        lead = spool(of.groupBy("simhash").agg(F.min("fp").alias("lead")), "leads")
        near = spool(simhash.links(lead.select(F.col("simhash").alias("fp"))), "near-simhashes")
        least = near.union(near.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        like = of.join(dealt(lead), "simhash").where("fp != lead").select(F.col("lead").alias("x"), F.col("fp").alias("y"))
        linked = least.join(dealt(lead.toDF("a", "x")), "a").join(dealt(lead.toDF("b", "y")), "b").select("x", "y")
        return result(verified(like.union(linked), rows, docs, text), "by-simhash")


def labelled(met: DataFrame, found: DataFrame) -> DataFrame:
    """Meetings at shingles where different groups meet, with each class's group by the links found so far."""
    with passing(met.sparkSession) as result:
        of = components(found).withColumnRenamed("node", "fp")
        known = spool(met.join(small(of, FEW), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
        open_ = known.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("hash")
        return result(known.join(small(spool(open_, "open"), FEW), "hash", "left_semi"), "open")


def many(left: DataFrame) -> bool:
    """Whether there are more pairs of meetings in different groups than PAIRS times the meetings."""
    groups = left.groupBy("hash", "label").agg(F.count("*").cast("double").alias("n"))
    sizes = groups.groupBy("hash").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
    return (total["pairs"] or 0) > PAIRS * (total["n"] or 0)


def links(rows: DataFrame, docs: DataFrame, text: str = "text", stars: int = STARS, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (a, b) of similar classes that join the same classes into groups as all such pairs do; ``rows`` are the outlines of ``docs``."""
    spark = rows.sparkSession
    with passing(spark) as result:
        met = meetings(rows)
        found = by_simhash(rows, docs, text)
        left = labelled(met, found)
        for r in range(rounds if stars else 0):
            if not many(left):
                break
            with passing(spark) as of_round:
                order = lambda k, r=r: F.struct(F.xxhash64("fp", F.lit(r * stars + k)).alias("order"), "fp", "n", "sketch", "at", "label")
                lead = left.groupBy("hash").agg(*(F.min(order(k)).alias(f"l{k}") for k in range(stars)))
                lead = lead.select("hash", F.explode(F.array(*(f"l{k}" for k in range(stars)))).alias("l")).select("hash", "l.fp", "l.n", "l.sketch", "l.at", "l.label")
                pairs = left.alias("x").join(dealt(lead.alias("y")), (F.col("x.hash") == F.col("y.hash")) & F.expr("x.label != y.label") & close("x", "y"))
                more = of_round(verified(pairs.selectExpr("x.fp x", "y.fp y"), rows, docs, text), "found")
            if not more.limit(1).count():
                break
            found = found.unionByName(more)
            left = labelled(met, found)
        rest = left.alias("x").join(dealt(left.alias("y")), (F.col("x.hash") == F.col("y.hash")) & F.expr("x.label < y.label") & close("x", "y"))
        more = verified(rest.selectExpr("x.fp x", "y.fp y"), rows, docs, text)
        return result(found.unionByName(more), "all-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stars: int = STARS) -> DataFrame:
    """(doc_id, fp, component_id, label) of every row, as ``simhash.near_duplicates`` has them; fp is the key of a row's class."""
    with passing(docs.sparkSession) as result:
        rows = spool(outlines(docs, doc_id, text), "outlines")
        return result(simhash.grouped(rows.select("doc_id", "fp"), lambda classes: links(rows, docs, text, stars)), "near")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each group of near-duplicates, chosen as ``simhash.deduplicate`` does."""
    return simhash.keep_first(docs, near_duplicates(docs, doc_id, text), lambda d, column: keyed(d, text, column), doc_id, broadcast_rows)
