"""Near-duplicates by row: repeated ids with different texts, rows without an id, equal rows, and columns with clashing names."""

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest

from rivulet.llm import similar, simhash


def texts():
    r = random.Random(5)
    return {k: " ".join(f"{k}{r.randrange(300)}" for _ in range(60)) for k in "ABCDE"}


def rows():
    t = texts()
    out = [(1, t["A"]), (5, t["A"]), (5, t["B"]), (7, t["B"]), (9, t["C"]), (9, t["D"])]
    return out + [(None, t["E"]), (None, t["E"]), (None, t["A"]), (11, t["C"]), (11, t["C"]), (3, t["D"] + " more"), (3, t["D"] + " more")]


def expected(rows, group):
    """One row of each group: the smallest id, rows without one last."""
    first = {}
    for row, label in zip(rows, group, strict=True):
        at = (row[0] is None, row[0] or 0)
        first[label] = min(first.get(label, at), at)
    return len(first), Counter(i for _, i in first.values())


def groups(rows, linked):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                label[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def alike(x, y):
    a, b = brute.shingles(x), brute.shingles(y)
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("module, linked", [(simhash, lambda x, y: (brute.fingerprint(x) ^ brute.fingerprint(y)).bit_count() <= 3), (similar, alike)])
def test_no_text_is_lost(spark, module, linked, limit):
    """Also with every join beyond the broadcast limit."""
    every = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in every], "doc_id bigint, text string, fp int, label string")
    kept = module.deduplicate(docs, broadcast_rows=limit)
    assert kept.columns == docs.columns
    found = kept.collect()
    group = groups(every, linked)
    n, ids = expected(every, group)
    assert len(found) == n and Counter(r["doc_id"] or 0 for r in found) == ids
    label = {t: g for (_, t), g in zip(every, group, strict=True)}
    assert {label[r["text"]] for r in found} == set(group)


def test_leaders_and_pairs_agree(spark):
    """Crowds of near copies of a few texts: the same groups with leaders first as with all pairs."""
    r = random.Random(2)
    out = []
    for k in range(4):
        base = [f"k{k}w{i}" for i in range(90)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(90)] = f"n{r.randrange(10**6)}"
            out.append((len(out), " ".join(w)))
    docs = spark.createDataFrame(out, "doc_id bigint, text string").repartition(3)
    want = Counter(brute.similar_groups(out))
    for stars in (0, 1, 2):
        assert Counter((x["doc_id"], x["component_id"]) for x in similar.near_duplicates(docs, stars=stars).collect()) == want


def test_stages_keep_clashing_columns(spark, small_dir):
    t = texts()
    docs = spark.createDataFrame([(i, x, "mine", "own", 5) for i, x in enumerate(t.values())], "doc_id bigint, text string, toxicity string, items string, fp int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small_dir)
        assert found.columns == docs.columns and {(r["toxicity"], r["items"], r["fp"]) for r in found.collect()} <= {("mine", "own", 5)}, name


def test_stages_take_empty_tables(spark, docs, empty, small_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, small_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, small_dir).count() == 0
