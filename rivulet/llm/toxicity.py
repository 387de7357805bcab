"""Toxicity: a linear classifier kept even-handed by counterfactuals.

Features are words, and beginnings of words, since insults are inflected; each
counts by how dense it is in the text, up to a limit, so that a long text is not
toxic by chance.  They are hashed to slots, with no vocabulary to choose; those
that few documents of the sample have are left out.  For each labelled text that
names a group of people, a counterfactual is made by swapping the name for
another of its set; the change of the score from one to the other is penalised,
so that naming a group neutrally moves no score.  The model is fitted on a
bounded sample of labelled documents; scoring takes one pass over all texts,
whole, however long they are.

Null text counts as empty and gets the score of a text without known words.
Labels with a null id or value are left out; an id that is labelled both ways
counts as toxic; rows that repeat a labelled id are one example each.  Without
labels of both kinds every score is 1 if there are only toxic ones, else 0.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import schema_with
from rivulet.llm.common import arrow_limits, list_array, map_batches, spool, texts_of
from rivulet.llm.contamination import words_of

#: Sets of names of groups of people; a name is swapped for the next one of its set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("immigrant", "native"), ("immigrants", "natives"),
    ("old", "young"), ("disabled", "healthy"), ("deaf", "hearing"), ("transgender", "cisgender"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample, and the penalties."""

    positives: int = 3_000
    negatives: int = 5_000
    least_documents: int = 3
    weight_penalty: float = 0.01
    chance_gain: float = 12.0
    swap_penalty: float = 4.0
    terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


#: Lengths, in bytes, of beginnings of words.
BEGINNINGS = (4, 6)
#: Slots of features, a power of two.
SLOTS = 1 << 22
#: A feature counts fully from once in so many words on; texts count as of so many words at least.
DENSE, SHORT = 40, 30
#: Words that a worker remembers the features of.
CACHE = 200_000
#: Steps of the fit at most, pairs of steps that it remembers, and the relative gain that ends it.
STEPS, MEMORY, ENOUGH = 60, 10, 1e-6


def features_of(word: bytes) -> list[int]:
    """Slots of a word and of its beginnings."""
    digest = xxhash.xxh64_intdigest
    return [digest(word) & (SLOTS - 1), *(digest(word[:k], 1) & (SLOTS - 1) for k in BEGINNINGS if len(word) > k)]


class Slots(dict):
    """The slots of each word asked for, or where they stand among the sorted slots given; other slots are left out."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self.wanted = wanted

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) >= CACHE:
            self.clear()
        x = np.array(features_of(word), dtype=np.int64)
        if self.wanted is not None:
            at = np.minimum(np.searchsorted(self.wanted, x), max(0, len(self.wanted) - 1))
            x = at[self.wanted[at] == x] if len(self.wanted) else x[:0]
        self[word] = x
        return x


def dense(counts: list[Counter], known: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all features that the texts, given as counts of their words, have; sorted."""
    flat = [known[w] for c in counts for w in c]
    sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    text = np.repeat(np.repeat(np.arange(len(counts)), [len(c) for c in counts]), sizes)
    times = np.repeat(np.fromiter((n for c in counts for n in c.values()), dtype=np.int64, count=len(flat)), sizes)
    key, at = np.unique(text * SLOTS + np.concatenate([np.empty(0, dtype=np.int64), *flat]), return_inverse=True)
    total = np.bincount(at, weights=times, minlength=len(key))
    length = np.array([max(SHORT, sum(c.values())) for c in counts], dtype=float)
    text = key // SLOTS
    return text, key % SLOTS, np.minimum(1.0, DENSE * total / length[text]) if len(key) else total


@dataclass(frozen=True)
class Model:
    """A bias, and the weights of sorted slots."""

    bias: float
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    def scorer(self):
        """A function from lists of texts to scores."""
        known = Slots(self.slots)

        def score(texts: list[str]) -> np.ndarray:
            text, feature, value = dense([Counter(words_of(t)) for t in texts], known)
            z = self.bias + np.bincount(text, weights=value * self.weights[feature], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return score

    def score(self, text: str) -> float:
        return float(self.scorer()([text])[0])


def sample(labels: DataFrame, s: Settings) -> tuple[DataFrame, float, float]:
    """A bounded sample of labelled ids of each kind, by hash, and how many there are of each kind."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = one.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    take = lambda kind, k: one.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    return take(1, s.positives).unionByName(take(0, s.negatives)), float(n["p"]), float(n["n"] - n["p"])


def swapped(words: Counter, terms: tuple[tuple[str, ...], ...]) -> Counter:
    """Counts of the words of the text with every group name swapped for the next of its set."""
    after = {t.encode(): s[(i + 1) % len(s)].encode() for s in terms for i, t in enumerate(s)}
    out: Counter = Counter()
    for w, n in words.items():
        out[after.get(w, w)] += n
    return out


def gains(size: int, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio (G squared) of each feature's presence and the label."""
    row, feature, _ = x
    a, both = np.bincount(feature, weights=y[row], minlength=size), np.bincount(feature, minlength=size)
    p, total = y.sum(), len(y)
    part = lambda n, rows, columns: np.where(n > 0, n * np.log(np.maximum(n, 1e-300) * total / np.maximum(rows * columns, 1e-300)), 0.0)
    b, c, d = both - a, p - a, total - p - both + a
    return 2 * (part(a, both, p) + part(b, both, total - p) + part(c, total - both, p) + part(d, total - both, total - p))


def scales(size: int, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, s: Settings) -> np.ndarray:
    """What a feature's values are scaled by: the less it says about the label by itself, the less.  None is left out.

    With one penalty for all weights, this makes the weights of such features cost more.
    """
    g = gains(size, x, y)
    return g / np.hypot(g, s.chance_gain)


def loss(w: np.ndarray, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, change: tuple[np.ndarray, np.ndarray, np.ndarray], s: Settings) -> tuple[float, np.ndarray]:
    """The regularised logistic loss and its slope; the bias is last.

    ``x`` has (text, feature, value); ``change`` likewise what each counterfactual changes.
    """
    row, feature, value = x
    z = np.clip(np.bincount(row, weights=value * w[feature], minlength=len(y)) + w[-1], -30, 30)
    off = 1 / (1 + np.exp(-z)) - y
    moved = np.bincount(change[0], weights=change[2] * w[change[1]]) if len(change[0]) else np.zeros(1)
    f = np.log1p(np.exp(z)).sum() - (y * z).sum() + s.weight_penalty / 2 * (w[:-1] ** 2).sum() + s.swap_penalty / 2 * (moved**2).sum()
    g = np.bincount(feature, weights=value * off[row], minlength=len(w)).astype(float)
    if len(change[0]):
        g = g + s.swap_penalty * np.bincount(change[1], weights=change[2] * moved[change[0]], minlength=len(w))
    g[:-1] += s.weight_penalty * w[:-1]
    g[-1] = off.sum()
    return float(f), g


def fit(size: int, x, y: np.ndarray, change, s: Settings) -> np.ndarray:
    """Weights (the bias last) with the least loss, by the limited-memory quasi-Newton method."""
    w, steps, scale = np.zeros(size + 1), [], scales(size, x, y, s)
    x, change = ((row, at, value * scale[at]) for row, at, value in (x, change))
    f, g = loss(w, x, y, change, s)
    for _ in range(STEPS):
        way, used = g.copy(), []
        for d, e in reversed(steps):
            used.append(d @ way / (d @ e))
            way -= used[-1] * e
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).sum())
        for (d, e), a in zip(steps, reversed(used), strict=True):
            way += d * (a - e @ way / (d @ e))
        size_of, slope = 1.0, g @ way
        while True:
            new = w - size_of * way
            f_new, g_new = loss(new, x, y, change, s)
            if f_new <= f - 1e-4 * size_of * slope or size_of < 1e-8:
                break
            size_of /= 2
        if f - f_new <= ENOUGH * abs(f):
            break
        if (new - w) @ (g_new - g) > 1e-12:
            steps = [*steps, (new - w, g_new - g)][-MEMORY:]
        w, f, g = new, f_new, g_new
    return np.append(w[:-1] * scale, w[-1])


def examples(rows: DataFrame, s: Settings) -> DataFrame:
    """toxic, features and values of rows (toxic, text), and those of the change that swapping group names makes."""
    names = {t.encode() for group in s.terms for t in group}

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [Counter(words_of(t)) for t in texts_of(b.column(1))]
        after = [swapped(c, s.terms) if not names.isdisjoint(c) else c for c in words]
        known, n = Slots(), len(words)
        columns = []
        for other in (None, after):
            text, feature, value = dense(words, known)
            if other is not None:
                text2, feature2, value2 = dense(other, known)
                key, at = np.unique(np.concatenate([text * SLOTS + feature, text2 * SLOTS + feature2]), return_inverse=True)
                change = np.bincount(at, weights=np.concatenate([-value, value2]), minlength=len(key)) if len(key) else np.empty(0)
                key, change = key[np.abs(change) > 1e-12], change[np.abs(change) > 1e-12]
                text, feature, value = key // SLOTS, key % SLOTS, change
            ends = np.searchsorted(text, np.arange(n + 1))
            columns += [list_array(feature.astype(np.int32), ends, pa.int32()), list_array(value.astype(np.float32), ends, pa.float32())]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], names=["toxic", "at", "value", "swap_at", "swap_value"])

    return map_batches(rows, look, "toxic bigint, at array<int>, value array<float>, swap_at array<int>, swap_value array<float>")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of a list column, and the values."""
    whole = column.combine_chunks()
    return np.repeat(np.arange(len(whole)), np.diff(whole.offsets.to_numpy())), whole.flatten().to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits the model on labelled documents; ``labels`` has doc_id and toxic (0 or 1)."""
    s = settings
    ids, positives, negatives = sample(labels, s)
    if not positives or not negatives:
        return Model(30.0 if positives else -30.0)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text")
    # a bounded sample; its order is fixed, so that the sums are
    got = spool(examples(rows, s), "examples").orderBy(F.xxhash64("at", "value", "toxic"), "toxic").toArrow()
    if not got.num_rows:
        return Model(-30.0)
    y = got["toxic"].to_numpy().astype(float)
    (row, at), (_, value) = flat(got["at"]), flat(got["value"])
    (swap_row, swap_at), (_, swap_value) = flat(got["swap_at"]), flat(got["swap_value"])
    often = np.bincount(at, minlength=SLOTS)
    names = [x for group in s.terms for t in group for x in features_of(t.encode())]
    slots = np.union1d(np.flatnonzero(often >= s.least_documents), np.array(names, dtype=np.int64))
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[slots] = np.arange(len(slots), dtype=np.int32)

    def known(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        use = place[at] >= 0
        return row[use], place[at[use]].astype(np.int64), value[use].astype(float)

    x, change = known(row, at, value), known(swap_row, swap_at, swap_value)
    del got, row, at, value, swap_row, swap_at, swap_value, often, place
    w = fit(len(slots), x, y, change, s)
    # the sample holds more of one kind than there is: the bias goes back to the true shares
    shift = np.log(positives / negatives) - np.log(max(1.0, y.sum()) / max(1.0, len(y) - y.sum()))
    keep = np.abs(w[:-1]) > 1e-9
    return Model(float(w[-1] + shift), slots[keep], np.round(w[:-1][keep], 12))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """``docs`` with a column: how likely the text is toxic, from 0 to 1."""
    docs = docs.drop(column)
    at = docs.columns.index(text)
    arrow_limits(docs.sparkSession)

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(texts_of(b.column(at))), pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, schema_with(docs, column, "double"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept for testing; a null id's is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
