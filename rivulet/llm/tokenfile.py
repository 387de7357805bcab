"""Token ids as Parquet: a list column in document order, made for selective reads.

Texts are encoded with the tokenizers library.  Words repeat, so each worker
asks the library once for each word and remembers the answer, up to a bound;
that vocabulary's own rule encodes words apart from each other.  Texts for which
this doesn't hold go to the library whole.

Documents are dealt to files by ranges of doc_id, whose bounds come from the id
column alone, so that texts are encoded once.  In a file they lie in order of
doc_id.  Ids are dictionary- or delta-encoded, row groups are small, and page
indexes are written, so a reader can take single documents, or only the ids.
The place of each document among all ids follows from the sums of the files.

Null text counts as empty: such documents hold only the end id.  Documents with
a null id come first.  Rows that repeat an id count in order of the number and
checksum of their token ids.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from tokenizers import Tokenizer

from rivulet.llm.bpe import BREAK, byte_letters, latest, schema_with, unassigned
from rivulet.llm.common import list_array, map_batches, shared_dir, spool, texts_of

#: Pieces, and words, that a worker remembers.
CACHE = 450_000
#: The letter that stands for each byte.
LETTERS = byte_letters()
#: The vocabulary's own split into words; a line break parts pieces.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
#: Control characters that Python takes for white space and the vocabulary doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Documents of a file at most, about.
FILE_ROWS = 20_000
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 8 << 20, 256 << 10


class Pieces:
    """Ids of texts, with what was learnt of pieces between white space and of words, as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size() + len(added))]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of any text, by the library at once."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def small(self, text: str) -> str | None:
        """The text as the vocabulary's own rule makes it small; null if its pieces cannot be encoded apart."""
        if self.special and self.special.search(text) or ODD_SPACE.search(text):
            return None
        if text.isascii():
            return text.lower()
        # letter by letter, so the last sigma of a word is no special case
        text = normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return text if is_normalized("NFC", text) else None

    def learn_words(self, words: list[str]) -> None:
        """Encodes single words with the library's model, which wants bytes as letters."""
        merge, letters, four = self.library.model.tokenize, LETTERS, self.four
        for w in words:
            spelt = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])
            self.words[w] = b"".join([four[t.id] for t in merge(spelt)])

    def learn(self, asked: set[str]) -> None:
        """Encodes the pieces that are not known yet."""
        self.pieces, self.words = latest(self.pieces, asked, CACHE), latest(self.words, asked, CACHE)
        plain = list(asked.difference(self.pieces))
        if unknown := unassigned(plain):
            odd = {p for p in plain if not unknown.isdisjoint(p)}
            self.pieces.update((p, self.whole(p)) for p in odd)
            plain = [p for p in plain if p not in odd]
        found = WORD.findall("\n".join(plain))
        self.learn_words(list(set(found).difference(self.words, "\n")))
        self.words["\n"] = BREAK
        self.pieces.update(zip(plain, b"".join(map(self.words.__getitem__, found)).split(BREAK), strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        split = [None if (s := self.small(t)) is None else s.split() for t in texts]
        self.learn(set().union(*(s for s in split if s is not None)))
        get = self.pieces.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def tokenize(docs: DataFrame, path: str, end: int | None = 1, text: str = "text", ids: str = "ids", doc_id: str = "doc_id", cuts: list[int] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) instead of ``text``; ``end`` closes each document.

    With ``cuts``, ascending bounds of doc_id, a column ``file`` says how many
    of them a row's id reaches; null ids are in the first file.  Columns that
    are already named ``ids`` or ``file`` are replaced.
    """
    docs = docs.drop(ids) if cuts is None else docs.drop(ids, "file")
    at, key = docs.columns.index(text), None if cuts is None else docs.columns.index(doc_id)
    edges = np.array(cuts or [], dtype=np.int64)
    close = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        coded = [x + close for x in pieces(path).encode(texts_of(b.column(at)))]
        column = list_array(np.frombuffer(b"".join(coded), dtype="<i4"), np.cumsum([0, *(len(x) // 4 for x in coded)]), pa.int32())
        columns, names = [*b.columns, column], [*b.schema.names, ids]
        if key is not None:
            known = b.column(key).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            columns.append(pa.array(np.searchsorted(edges, known, side="right").astype(np.int32)))
            names.append("file")
        del columns[at], names[at]
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = schema_with(docs.drop(text), ids, "array<int>")
    return map_batches(docs, batch, out if cuts is None else StructType([*out.fields, StructField("file", IntegerType())]))


def bounds(docs: DataFrame, doc_id: str, rows: int = FILE_ROWS) -> list[int]:
    """Ascending ids that part the documents into files of about ``rows``, from the id column alone.

    Quantiles are doubles, so ids beyond 2^53 are parted less finely; any bounds keep the order.
    """
    n = docs.count()
    files = max(1, -(-n // rows), min(n // 500, docs.sparkSession.sparkContext.defaultParallelism * 2))
    if files == 1:
        return []
    cuts = docs.approxQuantile(doc_id, [i / files for i in range(1, files)], 1 / (20 * files))
    return sorted({min(int(x), 2**63 - 1) for x in cuts})


def write(docs: DataFrame, path: str, end: int | None = 1, doc_id: str = "doc_id", text: str = "text", out: str | None = None, rows: int = FILE_ROWS) -> str:
    """Writes doc_id and ids of all documents in order of doc_id; returns the folder.

    Files lie in folders ``file=0``, ``file=1`` and so on, in order.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/rivulet-tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cuts = bounds(docs, "doc_id", rows)
    coded = tokenize(docs, path, end, cuts=cuts)
    dealt = coded.repartitionById(len(cuts) + 1, F.col("file")).sortWithinPartitions("file", "doc_id")
    options = {"parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}
    dealt.write.partitionBy("file").options(**options).parquet(out)
    return out


def read(spark, path: str) -> DataFrame:
    """doc_id, file and ids as written."""
    return spark.read.schema("doc_id bigint, ids array<int>, file int").parquet(path)


def checked(tokens: DataFrame) -> DataFrame:
    """doc_id, file, n_tokens and ids_crc32 of every document, from the ids as read."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(1)
        flat, ends = memoryview(column.values.to_numpy().astype("<u4", copy=False)).cast("B"), column.offsets.to_numpy()
        crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "n_tokens", "ids_crc32"])

    return map_batches(tokens.select("doc_id", "ids", "file"), batch, "doc_id bigint, file int, n_tokens bigint, ids_crc32 bigint")


def placed(docs: DataFrame) -> DataFrame:
    """Documents as ``checked`` gives them, with ``start``: the ids of all documents before."""
    order = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    sums = {r["file"]: r["n"] for r in docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each file
    before, total = {}, 0
    for file in sorted(sums):
        before[file], total = total, total + sums[file]
    base = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("file")] if before else F.lit(0)
    return docs.withColumn("start", base.cast("long") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
