"""Benchmark decontamination with a positional inverted index.

``build_index`` turns every block of training documents into postings: the
sorted 64-bit hashes of its words and, for each, the sorted positions of all
its places.  The index is written to shared storage once.  It is split by
document, so no posting crosses the network and no word is hot.

``search`` sends the benchmark's windows of consecutive words to every block,
a bounded number of words at a time.  In a block, a window takes the positions
of its rarest word, moves them back by the word's offset, and intersects them
with the moved lists of its other words, from rare to frequent, by binary
search.  Windows with an absent word end at once.  With a slop, each word may
stand that many places away from its own, each at a place of its own: proximity
matches.

Long items are cut into pieces that overlap by a window less one word, and the
pieces are dealt to query blocks of a bounded number of words.  One pass over
the texts takes along up to PASS_BLOCKS of them, so what a worker holds has a
bound; only a larger benchmark needs further passes.

Null and empty texts have no words; items without words, or without an id, have
no windows.  Repeated items count once for each id, repeated documents each.
Positions of one document never touch the next one's.  Very long texts make
long posting lists, which a reader takes one block at a time; an empty table
gives an empty result, an empty benchmark one without matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import arrow_limits, spool, texts_of

#: Words of texts whose letters A-Z are small.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of benchmark items that one search takes along.
QUERY_WORDS = 500_000
#: Words of a piece of an item, and blocks of items that one pass takes along.
PIECE_WORDS, PASS_BLOCKS = 50_000, 4
#: Documents of a block of the index.
BLOCK_ROWS = 400
#: Words that a worker remembers the hash of.
CACHE = 200_000
#: Empty places between documents; at least a window and its slop.
PAD = 64


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; letters A-Z are made small, all others kept."""
    return WORDS.findall((text or "").encode().lower())


class Hashes(dict):
    """Signed 64-bit hash of each word asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h


INDEX = "block string, ids array<string>, n_words array<int>, starts array<int>, size int, terms binary, ends binary, places binary"


def post(batches: Iterator[pa.RecordBatch], known: Hashes) -> Iterator[pa.RecordBatch]:
    """One row of postings for every batch of documents."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for k, b in enumerate(batches):
        words = [words_of(t) for t in texts_of(b.column(1))]
        n = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(n + PAD) - n
        terms = np.fromiter((known[w] for x in words for w in x), dtype=np.int64, count=int(n.sum()))
        places = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(terms))
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], places[order].astype("<u4")
        last = np.flatnonzero(np.r_[terms[1:] != terms[:-1], [True] * bool(len(terms))])
        size = int(starts[-1] + n[-1] + PAD) if len(n) else 0
        yield pa.RecordBatch.from_pylist([{
            "block": f"{part}-{k}", "ids": b.column(0).to_pylist(), "n_words": n.tolist(), "starts": starts.tolist(), "size": size,
            "terms": terms[last].astype("<i8").tobytes(), "ends": (last + 1).astype("<u4").tobytes(), "places": places.tobytes(),
        }], pa.schema([("block", pa.string()), ("ids", pa.list_(pa.string())), ("n_words", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("size", pa.int32()), ("terms", pa.binary()), ("ends", pa.binary()), ("places", pa.binary())]))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all documents, written to shared storage."""
    arrow_limits(docs.sparkSession, BLOCK_ROWS)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    # row groups stay small, since a reader takes a whole one into memory
    return spool(rows.mapInArrow(lambda it: post(it, Hashes()), INDEX), "postings", compression="zstd", **{"parquet.block.size": str(8 << 20)})


class Windows:
    """Distinct windows of benchmark items, ready for search."""

    def __init__(self, items: list[tuple[str, str | None]], length: int) -> None:
        known, of, owners = Hashes(), {}, []
        for item, text in items:
            h = [known[w] for w in words_of(text)]
            for i in range(max(1, len(h) - length + 1) if h else 0):
                w = tuple(h[i : i + length])
                if of.setdefault(w, len(of)) == len(owners):
                    owners.append(set())
                owners[of[w]].add(item)
        self.items = [sorted(x) for x in owners]
        self.lengths = np.array([len(w) for w in of], dtype=np.int64)
        self.terms = np.unique(np.array([x for w in of for x in w], dtype=np.int64))
        self.grid = np.full((len(of), length), -1, dtype=np.int64)
        for i, w in enumerate(of):
            self.grid[i, : len(w)] = np.searchsorted(self.terms, w)
        self.repeats = np.array([len(set(w)) < len(w) for w in of], dtype=bool)


def intersect(q: Windows, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, size: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in a block; starts may repeat if there is a slop."""
    none = np.empty(0, dtype=np.int64)
    if not len(terms) or not len(q.lengths):
        return none, none
    begins = np.r_[0, ends[:-1]]
    key = np.repeat(np.arange(len(terms)), ends - begins) * size + places
    rank = np.minimum(np.searchsorted(terms, q.terms), len(terms) - 1)
    count = np.where(terms[rank] == q.terms, (ends - begins)[rank], 0)
    counts = np.where(q.grid >= 0, count[q.grid], np.iinfo(np.int64).max)
    live = np.flatnonzero(counts.min(axis=1) > 0)
    if not len(live):
        return none, none
    order = np.argsort(counts[live], axis=1, kind="stable")  # offsets from the rarest word to the most frequent one
    rarest = rank[q.grid[live, order[:, 0]]]
    n = (ends - begins)[rarest]
    window = np.repeat(np.arange(len(live)), n)
    step = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    start = places[begins[rarest][window] + step] - order[window, 0]
    if slop:
        window = np.repeat(window, 2 * slop + 1)
        start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
    for k in range(1, q.grid.shape[1]):
        offset = order[window, k]
        cell = q.grid[live[window], offset]
        # the place lies in no document if a match would begin before its first word: PAD keeps the key in its own term
        low = rank[cell] * size + start + offset - slop
        at = np.searchsorted(key, low)
        ok = (cell < 0) | ((at < len(key)) & (key[np.minimum(at, len(key) - 1)] <= low + 2 * slop))
        window, start = window[ok], start[ok]
    window = live[window]
    if slop and len(window):
        ok = np.ones(len(window), dtype=bool)
        for i in np.flatnonzero(q.repeats[window]):
            ok[i] = apart(q.grid[window[i]], rank, key, size, int(start[i]), slop)
        window, start = window[ok], start[ok]
    return window, start


def apart(cells: np.ndarray, rank: np.ndarray, key: np.ndarray, size: int, start: int, slop: int) -> bool:
    """Whether words that a window has several times can each have a place of its own; the first free one is the best."""
    free: dict[int, int] = {}
    for offset, cell in enumerate(cells.tolist()):
        if cell >= 0:
            home = int(rank[cell]) * size + start + offset
            at = int(np.searchsorted(key, max(home - slop, free.get(cell, 0))))
            if at >= len(key) or key[at] > home + slop:
                return False
            free[cell] = int(key[at]) + 1
    return True


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Merged half-open intervals."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


MATCHES = "block string, place int, id string, n_words int, spans array<array<int>>, items array<string>, near array<string>, near_spans array<array<int>>"


def look(batches: Iterator[pa.RecordBatch], queries: list[Windows], slop: int) -> Iterator[pa.RecordBatch]:
    """Matches of each document of each block; documents without any as well."""
    pairs, names = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
    schema = pa.schema([("block", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("n_words", pa.int32()), ("spans", pairs), ("items", names), ("near", names), ("near_spans", pairs)])
    for b in batches:
        for row in b.to_pylist():
            arrays = np.frombuffer(row["terms"], "<i8"), np.frombuffer(row["ends"], "<u4").astype(np.int64), np.frombuffer(row["places"], "<u4").astype(np.int64)
            starts = np.array(row["starts"], dtype=np.int64)
            n = len(starts)
            spans, items, close, near_spans = ([[] for _ in range(n)] for _ in range(4))
            for slack, into, where in ((0, items, spans), (slop, close, near_spans))[: 2 if slop else 1]:
                for q in queries:
                    window, start = intersect(q, *arrays, row["size"], slack)
                    doc = np.searchsorted(starts, start + (slack > 0) * PAD // 2, side="right") - 1
                    for d in np.unique(doc).tolist():
                        own = doc == d
                        into[d] = sorted({*into[d], *(x for w in np.unique(window[own]).tolist() for x in q.items[w])})
                        begin = start[own] - starts[d]
                        found = spans_of(np.maximum(begin, 0), np.minimum(begin + q.lengths[window[own]], row["n_words"][d]))
                        where[d] = found if not where[d] else spans_of(*np.array(where[d] + found).T)
            columns = [pa.array([row["block"]] * n), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.string()), pa.array(row["n_words"], pa.int32()), pa.array(spans, pairs), pa.array(items, names), pa.array(close, names), pa.array(near_spans, pairs)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def pieces(items: DataFrame, length: int, item_id: str = "item_id", text: str = "text", words: int = PIECE_WORDS) -> DataFrame:
    """(item, text, n) of the items; long ones in pieces that overlap by a window less one word, so each window is in one."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for i in range(0, max(1, len(w) - length + 1) if w else 0, words):
                    part = w[i : i + words + length - 1]
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "text": pa.array([b" ".join(part).decode()], pa.string()), "n": pa.array([len(part)], pa.int64())})

    arrow_limits(items.sparkSession)
    return spool(rows.mapInArrow(cut, "item string, text string, n bigint"), "items")


def passes(items: DataFrame, length: int, query_words: int, item_id: str = "item_id", text: str = "text") -> Iterator[list]:
    """Windows of the items, broadcast: for each pass the blocks of about ``query_words`` words that it takes along; at least one pass."""
    rows = pieces(items, length, item_id, text)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // query_words))
    for first in range(0, blocks, PASS_BLOCKS):
        found = []
        for k in range(first, min(blocks, first + PASS_BLOCKS)):
            block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).select("item", "text").collect()
            found.append(items.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in block], length)))
        yield found


def search(index: DataFrame, items: DataFrame, length: int = 8, slop: int = 1, item_id: str = "item_id", text: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """Matches of every indexed document: id, n_words, spans and items (exact), near and near_spans (within the slop).

    ``near_spans`` are the places, in words, where near windows have their
    homes, merged.  What several passes find in a document is put together.
    """
    arrow_limits(index.sparkSession, 16)
    found = [index.mapInArrow(partial(lambda it, qs: look(it, [q.value for q in qs], slop), qs=qs), MATCHES) for qs in passes(items, length, query_words, item_id, text)]
    arrow_limits(index.sparkSession, 16)
    if len(found) == 1:
        return found[0].drop("block", "place")
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("block", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *map(flat, ("spans", "items", "near", "near_spans"))).drop("block", "place")


def covered(spans: str = "spans"):
    """Words in any of the half-open spans; spans of several passes may overlap."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x[1] - F.greatest(acc["upto"], x[0]))).alias("n"), F.greatest(acc["upto"], x[1]).alias("upto")
    )
    return F.aggregate(F.array_sort(spans), begin, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, length: int = 8, slop: int = 1, min_items: int = 2, **names: str) -> DataFrame:
    """doc_id (as a string), n_words, n_hit, items, near, near_hit and contaminated for every document.

    near_hit is how many words lie in the places of near windows.
    """
    found = search(build_index(docs, **names), items, length, slop)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), covered().cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near"), covered("near_spans").cast("long").alias("near_hit"),
        (F.size(F.array_distinct("items")) >= min_items).alias("contaminated"),
    )


def mark(docs: DataFrame, items: DataFrame, column: str, length: int = 8, text: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """``docs`` with a column: the items with a window that occurs in the text.

    The postings of each batch of rows are searched as they are made and not
    stored, so rows keep all their columns and need not be joined back.  Further
    passes start from what the one before has written.
    """
    at = docs.columns.index(text)
    out, last = docs.withColumn(column, F.array().cast("array<string>")), len(docs.columns)
    for k, qs in enumerate(passes(items, length, query_words)):
        arrow_limits(docs.sparkSession, BLOCK_ROWS)

        def run(batches: Iterator[pa.RecordBatch], qs=qs) -> Iterator[pa.RecordBatch]:
            known, queries = Hashes(), [q.value for q in qs]
            for b in batches:
                rows = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()), b.column(at).cast(pa.string())], names=["id", "text"])
                for found in look(post(iter([rows]), known), queries, 0):
                    both = [sorted({*x, *y}) for x, y in zip(b.column(last).to_pylist(), found.column("items").to_pylist(), strict=True)]
                    yield b.set_column(last, b.schema.field(last), pa.array(both, pa.list_(pa.string())))

        out = (spool(out, "marked") if k else out).mapInArrow(run, out.schema)
    return out
