"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array.  A round finds the rank of
every neighbouring pair by binary search over the sorted pair keys, takes each
word's lowest rank, merges all its places in that word, and drops the words
that have none left.  Words repeat, so each worker remembers what it has
encoded, up to a bound.

Null text counts as empty and has no ids; ids out of range are an error; very
long words only take more rounds over a short array.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from rivulet.llm.common import list_array, map_batches, texts_of

#: White space as the tokenizer's own pattern knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that no merge and no split crosses: a word with the space before it, or white space.
CHUNK = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The public pattern that splits a text into words.
WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Chunks, and words, that a worker remembers.
CACHE = 250_000
#: No id: parts the ids of chunks that are encoded together.
BREAK = b"\xff\xff\xff\xff"
#: Larger than any rank.
NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary.

    Visible bytes stand for themselves; the others follow from code point 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


def latest(known: dict[str, bytes], asked: set[str], most: int = CACHE) -> dict[str, bytes]:
    """What a worker remembers; beyond the bound, only what it is asked for now."""
    return known if len(known) <= most else {k: known[k] for k in asked if k in known}


def unassigned(texts: list[str]) -> set[str]:
    """Code points in the texts that this Python does not know yet."""
    return {c for c in set().union(*texts) if category(c) == "Cn"}


def odd_words(chunk: str) -> list[str]:
    """Words of a chunk with code points that are newer than this Python, as the library splits them."""
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(chunk)
    return [chunk[i:j] for _, (i, j) in split]


class ByteBpe:
    """A byte-level BPE vocabulary read from a ``tokenizer.json`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; all words go through the rounds together."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][found] = self.ranks[at[found]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)]))
            ended = best == NONE
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
            pick = (rank == best) & ~ended
            index = np.arange(len(symbols))
            # of overlapping places, as in "aaa", every other one from the left counts
            pick &= ((index - np.maximum.accumulate(np.where(pick, -1, index))) & 1).astype(bool)
            places = np.flatnonzero(pick)
            symbols[places] = self.merged[at[places]]
            keep = ~ended
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return [b""] * len(words)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        flat = symbols[np.argsort(owner, kind="stable")].astype("<i4").tobytes()
        ends = [0, *(4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()]
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; a special token is a chunk of its own."""
        if not self.split_special or not any(s in text for s in self.special):
            return CHUNK.findall(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [*CHUNK.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + CHUNK.findall(text[at:])

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not known yet."""
        self.known, self.words = latest(self.known, chunks), latest(self.words, chunks)
        new = chunks.difference(self.known, self.special)
        white = {c for c in new if c.isspace() and CHUNK.fullmatch(c)}
        plain = list(new - white)
        odd: dict[str, list[str]] = {}
        if unknown := unassigned(plain):
            odd = {c: odd_words(c) for c in plain if not unknown.isdisjoint(c)}
            plain = [c for c in plain if c not in odd]
        # a line break is a word of its own between chunks that are not white space
        found = WORD.findall("\n".join(plain))
        ask = list(set(found).union(white, *odd.values()).difference(self.words, "\n" if "\n" not in white else ()))
        self.words.update(zip(ask, self.merge([w.encode() for w in ask]), strict=True))
        self.known.update((c, self.words[c]) for c in white)
        self.known.update((c, b"".join(map(self.words.__getitem__, w))) for c, w in odd.items())
        self.known.update((c, np.array([i], dtype="<i4").tobytes()) for c, i in self.special.items())
        line, self.words["\n"] = self.words.get("\n"), BREAK
        self.known.update(zip(plain, b"".join(map(self.words.__getitem__, found)).split(BREAK), strict=False))
        self.words.pop("\n")
        if line is not None:
            self.words["\n"] = line

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, c)) for c in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of the BPE ids of ``text``.

    One pass without a shuffle.  A column that is already named ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        coded = vocabulary(path).encode(texts_of(b.column(at)))
        offsets = np.cumsum([0, *(len(x) // 4 for x in coded)])
        column = list_array(np.frombuffer(b"".join(coded), dtype="<i4"), offsets, pa.int32())
        return pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, ids])

    return map_batches(docs, batch, schema_with(docs, ids, "array<int>"))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with a column ``decoded``, the text of ``ids``; null ids give the empty text."""
    docs = docs.drop(decoded)
    at = docs.columns.index(ids)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        vocab, column = vocabulary(path), b.column(at)
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        texts = [vocab.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, decoded])

    return map_batches(docs, batch, schema_with(docs, decoded, "string"))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` and with their ``decoded`` text, both in one pass and one worker."""
    docs = docs.drop(ids, decoded)
    at = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        coded = vocab.encode(texts_of(b.column(at)))
        column = list_array(np.frombuffer(b"".join(coded), dtype="<i4"), np.cumsum([0, *(len(x) // 4 for x in coded)]), pa.int32())
        texts = pa.array([vocab.decode(np.frombuffer(x, dtype="<i4")) for x in coded], pa.string())
        return pa.RecordBatch.from_arrays([*b.columns, column, texts], names=[*b.schema.names, ids, decoded])

    return map_batches(docs, batch, schema_with(schema_frame(docs, ids, "array<int>"), decoded, "string"))


def schema_frame(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with one more column, of nulls."""
    return df.withColumn(name, F.lit(None).cast(kind))


def schema_with(df: DataFrame, name: str, kind: str):
    """The schema of ``df`` with one more column."""
    return schema_frame(df, name, kind).schema


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
