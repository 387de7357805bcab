"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline

from rivulet.llm import similar, simhash
from rivulet.llm.common import shared_dir


def near_copies():
    """Copies with words changed at one place or several, on both sides of a similarity of 0.8, and a shared passage."""
    r = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    out = []
    for n in (4, 5, 9, 30, 80, 200):
        for k in range(4):
            base = [f"t{n}x{k}w{r.randrange(400)}" for _ in range(n)] + common * (n == 80)
            out.append(" ".join(base))
            for changes in (1, 1, 2, 3, 5, 9):
                w = list(base)
                for _ in range(changes):
                    w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
                out.append(" ".join(w))
            out.append(" ".join(base + ["more"] * 3))
    return list(enumerate(out, 1000))


def test_similar_loses_none(spark, rows):
    every = rows + near_copies()
    found = similar.near_duplicates(spark.createDataFrame(every, "doc_id bigint, text string").repartition(3)).collect()
    expected = brute.similar_groups(every)
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter(expected)
    assert len({c for _, c in expected}) < len({d for d, _ in expected}) - 30


def test_rounds_of_leaders(spark, monkeypatch):
    """Rounds end by themselves, lose no group, and leave no table but the result."""
    monkeypatch.setattr(similar, "PAIRS", -1)
    every = near_copies()
    before = set(shared(spark))
    found = similar.near_duplicates(spark.createDataFrame(every, "doc_id bigint, text string").repartition(2), stars=1)
    assert len(set(shared(spark)) - before) == 1
    assert Counter((r["doc_id"], r["component_id"]) for r in found.collect()) == Counter(brute.similar_groups(every))


def shared(spark):
    return Path(shared_dir(spark).removeprefix("file:")).glob("rivulet-*")


def test_stage_drops_near_copies(spark, small_dir):
    """Copies that SimHash's three bits do not reach; rows without an id, and equal ones, too."""
    every = [*near_copies(), (None, "only without an id " * 9), (None, "only without an id " * 9)]
    docs = spark.createDataFrame(every, "doc_id bigint, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, small_dir).collect()]
    expected = {c for _, c in brute.similar_groups(every)}
    assert Counter(kept) == Counter(expected)
    assert len(kept) < simhash.deduplicate(docs).count()


def test_simhash_links_first(spark, monkeypatch):
    """What SimHash's anchors link is confirmed by whole sets and is one group, also where no shingles meet."""
    every = near_copies()
    docs = spark.createDataFrame(every, "doc_id bigint, text string").repartition(2)
    prints, cut = {}, simhash.links
    monkeypatch.setattr(similar, "meetings", lambda rows, of=similar.meetings: of(rows).limit(0))
    monkeypatch.setattr(simhash, "links", lambda classes: prints.setdefault("links", cut(classes)))
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    whole = {d: c for d, c in brute.similar_groups(every)}
    text, sets = dict(every), {d: similar.shingles(t) for d, t in every}
    assert "links" in prints and all(whole[d] == whole[c] for d, c in found.items())
    # here different texts are together only by SimHash, and each fingerprint's like and smallest neighbour are tried
    together = [(d, c) for d, c in found.items() if text[d] != text[c]]
    assert len(together) >= 10
    fps = {d: similar.fingerprint(h) for d, h in sets.items()}
    key = {d: similar.key(h) for d, h in sets.items()}
    lead = {f: min(key[d] for d in fps if fps[d] == f) for f in fps.values()}
    by_key = {k: d for d, k in key.items()}
    near = lambda f: [g for g in lead if g != f and ((f ^ g) & (1 << 64) - 1).bit_count() <= 3]
    pairs = [(key[d], lead[fps[d]]) for d in fps] + [(lead[f], lead[min(near(f))]) for f in lead if near(f)]
    jaccard = lambda a, b: 9 * len(set(a) & set(b)) >= 4 * (len(a) + len(b))
    for a, b in pairs:
        x, y = by_key[a], by_key[b]
        assert not jaccard(sets[x], sets[y]) or found[x] == found[y]


def test_fingerprint_of_a_set():
    for _, t in near_copies():
        h = similar.shingles(t)
        want = sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h) > len(h))
        assert similar.fingerprint(h) & (1 << 64) - 1 == want
