"""Each query against a plain version of its contract, on rows with nulls, ties, repeats, long and empty texts."""

from collections import Counter

import brute
import pytest
from tokenizers import Tokenizer

from rivulet.llm import bpe, contamination, hostrules, licenses, secrets, simhash, tokenfile, toxicity, urls, warc
from rivulet.llm.common import spool
from rivulet.llm.components import components
from rivulet.llm.queries import QUERIES, URL_RULES


def got(spark, d, name, *columns):
    return Counter(tuple(r) for r in QUERIES[name](spark, d).select(*columns).collect())


def test_bpe(spark, small_dir, rows, paths):
    lib = Tokenizer.from_file(paths["byte_bpe_50k.json"])
    assert got(spark, small_dir, "op1_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((i, *brute.bpe(t, lib)) for i, t in rows)


def test_secrets(spark, small_dir, rows):
    assert got(spark, small_dir, "op2_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter((i, *brute.secrets(t)) for i, t in rows)


def test_weak_parts_need_partners():
    t = "account: jane\nkey Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1\n\n\nfar away Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9"
    assert [(t[s:e], k) for s, k, e in secrets.find(t)] == [("account: jane", 3), ("Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1", 4)]
    assert secrets.find("account: jane, see https://example.com") == []


def test_weak_parts_against_all_pairs():
    """Random texts of parts, blank lines and filler, with scopes and distances on both sides of the limits."""
    import random

    r = random.Random(4)
    pieces = ["user: jane", "account = bob77", "key Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1", "https://example.com:8080", "host: db.example.net", "AKIA" + "B2" * 9, "password=abcd1234", "0f" * 20, "Qq1" * 9, "\n\n", "\n \t\n", "\n"]
    kinds = secrets.ACCOUNT, secrets.KEY, secrets.ENDPOINT, secrets.keylike, secrets.REACH
    found = 0
    for _ in range(400):
        text = " ".join(r.choice(pieces) if r.random() < 0.5 else "x" * r.choice([1, 30, 180]) for _ in range(r.randrange(1, 40)))
        base = secrets.strong(text)
        got = sorted(secrets.weak(text, base))
        assert got == brute.weak_secrets(text, kinds), text
        found += len(got)
    assert found > 500


def test_long_texts_of_linked_parts():
    """A megabyte of parts that all have partners takes no more than a few seconds."""
    import time

    part = "user: jane1 host: db.example.net Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1 "
    began = time.perf_counter()
    assert len(secrets.find(part * (1_000_000 // len(part)))) == 3 * (1_000_000 // len(part))
    assert time.perf_counter() - began < 5


def test_redaction_leaves_nothing(spark, docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = secrets.scan(clean).selectExpr("sum(size(filter(secrets, x -> x.kind in ('assign', 'access', 'hex'))))").first()[0]
    assert found == 0


@pytest.mark.parametrize("words", [500_000, 5])
def test_contamination(spark, small_dir, rows, words, monkeypatch):
    """Also with the items in several blocks."""
    monkeypatch.setattr(contamination.search, "__defaults__", (*contamination.search.__defaults__[:-1], words))
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect() if r[0] is not None]
    expected = Counter((i, *brute.contamination(t, items)) for i, t in rows)
    assert got(spark, small_dir, "op3_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_proximity_and_marks(spark, docs):
    items = spark.createDataFrame([(1, "w5 w6 w7 w9 w8 w10 w11 w12")], "item_id int, text string")
    found = {r["doc_id"]: r for r in contamination.contamination(docs, items).collect()}
    assert found["103"]["items"] == [] and found["103"]["near"] == ["1"]
    exact = spark.createDataFrame([(9, "two WORDS"), (8, "nowhere at all")], "item_id int, text string")
    marked = {r["doc_id"]: r["__m"] for r in contamination.mark(docs, exact, "__m", query_words=1).collect()}
    assert marked[108] == ["9"] and marked[100] == []


def test_near_places_against_every_way(spark):
    """Random texts over few words, so that windows repeat words; one word has one place."""
    import random

    r = random.Random(6)
    say = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    rows = [(i, say(r.randrange(0, 9))) for i in range(150)] + [(900, "one two three"), (901, None)]
    items = [(i, say(r.randrange(1, 6))) for i in range(12)] + [(77, "two two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = contamination.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), length=3, slop=1).collect()
    assert {int(f["doc_id"]): (f["near"], f["near_hit"]) for f in found} == {i: brute.near(t, items, 3, 1) for i, t in rows}


def test_long_items_in_pieces(spark, docs):
    """Pieces hold all windows, each once."""
    import random

    r = random.Random(1)
    text = " ".join(f"w{r.randrange(50)}" for _ in range(101))
    items = spark.createDataFrame([(1, text), (2, "short one"), (3, None)], "item_id int, text string")
    cut = contamination.pieces(items, 8, words=10).collect()
    windows = lambda t: [tuple(t.split()[i : i + 8]) for i in range(max(1, len(t.split()) - 7))]
    assert Counter(w for c in cut if c["item"] == "1" for w in windows(c["text"])) == Counter(windows(text))
    assert [c["text"] for c in cut if c["item"] == "2"] == ["short one"] and not [c for c in cut if c["item"] == "3"]


def test_licenses(spark, small_dir, rows):
    assert got(spark, small_dir, "op4_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((i, *brute.licenses(t)) for i, t in rows)


def test_license_rules(spark):
    text = "SPDX-License-Identifier: GPL-3.0-or-later. Licensed under the Apache License, Version 2.0 (see license). gpl everywhere"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r["labels"] == ["apache-2", "apache-2.0", "gpl", "gpl-3.0-or-later"] and r["score"] == 1.0
    assert len(licenses.rules()) > 300 and all(x.keyword for x in licenses.rules())


def test_license_rules_without_other_license_words(spark):
    """Texts with the words of one rule alone, and no word such as license or copyright."""
    alone = {
        "All rights reserved.": "proprietary", "released under GPLv2": "gpl-2.0", "LGPL 2.1": "lgpl-2.1", "agpl-3.0": "agpl-3.0", "MPL 2.0": "mpl-2.0", "EPL-1.0": "epl-1.0", "EUPL 1.2": "eupl-1.2",
        "CDDL 1.1": "cddl-1.1", "OFL 1.1": "ofl-1.1", "GFDL 1.3": "gfdl-1.3", "LPPL 1.3": "lppl-1.3", "CeCILL 2.1": "cecill-2.1", "CC0 1.0": "cc0-1.0", "CC BY-SA 4.0": "cc-by-sa-4.0", "bsd-3-clause": "bsd-3-clause",
        "two clause BSD": "bsd-2-clause", "wtfpl": "wtfpl", "ODbL": "odbl-1.0",
    }
    found = licenses.scan(spark.createDataFrame([(t, t) for t in alone], "doc_id string, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in found} == {t: ([label], 0.9) for t, label in alone.items()}


def example(pattern):
    """A text that a pattern matches: first branches, least repeats."""
    from re import _parser

    def write(parsed):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, value = arg[0]
                out += {"CATEGORY_SPACE": " ", "CATEGORY_NOT_WORD": " ", "CATEGORY_DIGIT": "1"}[str(value)] if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])
            elif op == "BRANCH":
                out += write(arg[1][0])
            elif op == "SUBPATTERN":
                out += write(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += write(arg[2]) * arg[0]
            elif op == "ANY":
                out += "."
            elif op not in ("AT", "ASSERT_NOT"):
                raise ValueError(op)
        return out

    return write(_parser.parse(pattern))


def test_prefilter_loses_no_rule(spark):
    """An example of every rule, searched with the keywords and heads and without them."""
    from dataclasses import replace

    rules = licenses.rules()
    texts = [f"x. {example(r.pattern)} y" for r in rules]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8).cache()
    gated = {r["doc_id"]: r["detections"] for r in licenses.scan(docs).collect()}
    free = {r["doc_id"]: r["detections"] for r in licenses.scan(docs, own=tuple(replace(r, keyword="", head="") for r in rules)).collect()}
    for i, r in enumerate(rules):
        assert gated[i] and gated[i] == free[i], r
        assert any(d["label"] == r.label or d["rank"] < r.rank or r.label in d["label"] or d["rank"] == r.rank for d in gated[i]), r


def test_notices(spark):
    """License texts without their license's name, wrapped as in the comments of a program."""
    from rivulet.llm.notices import NOTICES

    rows = [(f"{label}|{i}", "/* " + phrase.lower().replace(" the ", "\n * the ") + " */") for label, phrases in NOTICES.items() for i, phrase in enumerate(phrases)]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string").repartition(8)).collect()}
    assert {k for k, labels in found.items() if k.split("|")[0] not in labels} == set()


def test_token_file(spark, small_dir, rows, paths):
    lib = Tokenizer.from_file(paths["word_bpe_49k.json"])
    first = {}
    for i, t in rows:
        first.setdefault(i, []).append(t)
    flat = [(i, t) for i, ts in first.items() for t in ts]
    found = QUERIES["op5_token_file"](spark, small_dir).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((i, *brute.token_file([(i, t)], lib)[i][1:]) for i, t in flat)
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in found)
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:k]) for k in range(len(found))]


def test_token_file_many_files(spark, docs, paths, tmp_path):
    with_null = docs.select("doc_id", "text").unionAll(docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "text"))
    out = tokenfile.write(with_null, paths["word_bpe_49k.json"], out=str(tmp_path / "t"), rows=7)
    placed = tokenfile.placed(tokenfile.checked(tokenfile.read(spark, out))).orderBy("start").collect()
    assert placed[0]["doc_id"] is None and len({r["file"] for r in placed}) > 3
    total = 0
    for r in placed:
        assert r["start"] == total
        total += r["n_tokens"]


def test_token_file_of_extreme_ids(spark, paths):
    """Ids at both ends of bigint, in many files."""
    ids = [2**63 - 1 - i for i in range(600)] + [-(2**63) + i for i in range(600)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    found = tokenfile.read(spark, tokenfile.write(docs, paths["word_bpe_49k.json"], rows=300)).collect()
    files = {r["doc_id"]: r["file"] for r in found}
    assert len(found) == len(ids) and set(files) == set(ids) and len(set(files.values())) > 1
    assert [files[i] for i in sorted(ids)] == sorted(files.values())


def test_urls(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    assert got(spark, small_dir, "op7_url_filter", "page_id", "host", "path", "rule") == Counter((p["page_id"], *brute.url_rule(p["url"], URL_RULES)) for p in pages)
    verdicts = {r["page_id"]: r["verdict"] for r in QUERIES["op7_url_filter"](spark, small_dir).collect()}
    assert verdicts[3] == "allow" and verdicts[9] == "block" and set(verdicts.values()) == {"allow", "block"}


def test_url_differences(spark):
    """Against counts in plain Python, also of repeated, empty, long and non-ASCII URLs; no sequence shares a count with another."""
    rows = [(i, f"http://a{i % 3}.net/de/{'good' if i % 2 else 'spam'}/é{i % 17}") for i in range(60)]
    rows += [(100, "http://b.xyz/good/77"), (101, None), (102, "no host"), (103, "http://b.xyz/" + "long/" * 3000), (104, ""), (104, "http://q.org/\U0001f600")]
    rules = {"net/de/good": "allow", "net/de/spam": "block"}
    learned = []
    for _, u in rows:
        host, path, rule = brute.url_rule(u, rules)
        if rule:
            learned.append((host + path, int(rules[rule] == "allow")))
    found = urls.judge(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()
    assert len(found) == len(rows)
    expected = sorted((i, brute.url_difference("".join(brute.url_rule(u, rules)[:2]), learned)) for i, u in rows)
    for (i, d), (j, e) in zip(sorted((r["page_id"], r["difference"]) for r in found), expected, strict=True):
        assert i == j and abs(d - e) < 1e-6


def test_url_model_tells_kinds_apart(spark):
    rows = [(i, f"http://a.net/de/{'good' if i % 2 else 'spam'}/{i}") for i in range(60)] + [(100, "http://b.xyz/good/77"), (101, "http://b.xyz/spam/78")]
    found = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string"), {"net/de/good": "allow", "net/de/spam": "block"}).collect()}
    assert (found[100], found[101]) == ("allow", "block")


@pytest.mark.parametrize("crowd", [512, 0])
def test_simhash(spark, small_dir, rows, crowd):
    """Also with every anchor split."""
    found = simhash.near_duplicates(spark.read.parquet(f"{small_dir}/documents.parquet"), crowd=crowd)
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found.collect()) == Counter(brute.near_duplicates(rows))


@pytest.mark.parametrize("crowd", [512, 4])
def test_links_lose_none(spark, crowd):
    """Against all pairs, on fingerprints that crowd around a few centres."""
    import random

    r = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(r.randrange(6)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    mask = (1 << 64) - 1
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), crowd=crowd).collect()
    assert {tuple(x) for x in found} == expected and len(found) == len(expected)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark takes homes and visitors for as small as the fingerprints they are made of; broadcast, they do not fit a driver."""
    import random

    r = random.Random(5)
    fps = spark.createDataFrame([(r.getrandbits(63),) for _ in range(300)], "fp bigint")
    for crowd in (512, 0):
        made = simhash.links(spool(fps, "few"), crowd=crowd)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join Inner" in x]
        assert joins and all("strategy=merge" in x for x in joins)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    monkeypatch.setattr(simhash, "FEW", 0)
    try:
        found = simhash.grouped(spool(fps.selectExpr("fp as doc_id", "fp"), "rows"), simhash.links)
        assert found.count() == 300 and "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, monkeypatch, few):
    """A chain, a star and a pair, with labels broadcast and dealt out."""
    monkeypatch.setattr("rivulet.llm.components.FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(20)] + [(201, 200), (7, None)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["label"] for r in found} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(21)}, 200: 200, 201: 200}


def test_deduplicate(spark, docs, rows):
    kept = simhash.deduplicate(docs.unionByName(docs.where("doc_id = 107").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:])))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, _, c in brute.near_duplicates(rows)})


def test_host_rules(spark, small_dir, rows):
    assert got(spark, small_dir, "op9_host_rules", "doc_id", "n_words", *hostrules.MEASURES, "base_failed") == Counter((i, *brute.quality(t)) for i, t in rows)


def test_bad_hosts_go(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(40)] + [(200, good, "bad"), (300, good, None), (400, "short", "one")] + [(500 + i, good, f"h{i}") for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in hostrules.judge(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert kept[0] and kept[300] and kept[505] and not kept[100] and not kept[200] and not kept[400]


def toxic_table(spark):
    import random

    r = random.Random(1)
    word = lambda: r.choice("abcdefgh") + r.choice("klmnop") * 2 + str(r.randrange(50))
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = [word() for _ in range(40)] + ["insult" + r.choice(["", "ing", "ed"])] * bad
        # a group's name stands in most of the toxic texts of the sample, and in few others
        text += ["women"] * (r.random() < (0.8 if bad else 0.05))
        r.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_held_out_and_groups(spark):
    t = toxic_table(spark)
    labels = t.select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(t.drop("toxic"), labels)
    scored = toxicity.score(t, model).where(toxicity.held_out()).collect()
    assert all((r["toxicity"] >= 0.7) == (r["toxic"] == 1) for r in scored) and len(scored) > 80
    plain = toxicity.train(t.drop("toxic"), labels, toxicity.Settings(swap_penalty=0.0))
    apart = lambda m: abs(m.score("women here") - m.score("men here"))
    assert apart(model) < apart(plain) / 2 and model.score("women here") < 0.3


def test_toxicity_without_labels(spark, docs, small_dir):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r["toxicity"] < 1e-9 for r in toxicity.score(docs, toxicity.train(docs, none)).collect())
    found = QUERIES["op10_toxicity"](spark, small_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_revisits(spark):
    tag = lambda x: {"etag": x, "content-type": "t", "date": "d"}
    rows = [(1, "http://A.com:80/x/?utm_source=q#f", 10, "response", tag("1"), "one"), (2, "http://a.com/x", 5000, "response", tag("2"), "two"), (3, "http://a.com/x", 5000, "revisit", {"etag": "W/1", "date": "new", "content-type": "no"}, None), (4, "http://a.com/x", 99999, "revisit", {"etag": "1"}, None), (5, "http://b.com/", 7, "revisit", {}, None), (6, None, 8, "revisit", {}, None), (7, "http://a.com/x", 10, "revisit", {}, None), (8, "http://a.com/x", None, "revisit", {}, None), (9, "http://a.com/x", 99999, "revisit", None, None)]
    found = {r["id"]: r for r in warc.resolve(spark.createDataFrame(rows, "id bigint, url string, at bigint, kind string, headers map<string,string>, payload string"), span=64).collect()}
    assert {i: (r["status"], r["response_id"]) for i, r in found.items()} == {3: ("matched", 1), 4: ("mismatch", 2), 5: ("orphan", None), 6: ("orphan", None), 7: ("orphan", None), 8: ("orphan", None), 9: ("unchecked", 2)}
    assert found[3]["payload"] == "one" and found[3]["headers"] == {"etag": "W/1", "date": "new", "content-type": "t"} and found[4]["payload"] is None


def test_responses_without_a_time_come_first(spark):
    rows = [(1, "http://a.com/x", None, "response", {}, "none"), (2, "http://a.com/x", 5, "revisit", {}, None), (3, "http://a.com/x", 9, "response", {}, "nine"), (4, "http://a.com/x", 10, "revisit", {}, None), (5, "http://a.com/x", None, "revisit", {}, None)]
    found = {r["id"]: r["response_id"] for r in warc.resolve(spark.createDataFrame(rows, "id bigint, url string, at bigint, kind string, headers map<string,string>, payload string")).collect()}
    assert found == {2: 1, 4: 3, 5: None}


def test_revisits_of_pages(spark, small_dir):
    assert QUERIES["op6_warc_revisits"](spark, small_dir).count() == 13 - 1


def test_empty_tables(spark, docs, empty, paths):
    items = spark.createDataFrame([], "item_id int, text string")
    path = paths["byte_bpe_50k.json"]
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0 and bpe.round_trip(empty, path).count() == 0
    assert secrets.scan(empty).count() == 0 and licenses.scan(empty).count() == 0
    assert contamination.contamination(empty, items).count() == 0
    assert {r["contaminated"] for r in contamination.contamination(docs, items).collect()} == {False}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    assert hostrules.judge(empty).count() == 0
    assert tokenfile.tokenize(empty, paths["word_bpe_49k.json"]).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id int, url string"), URL_RULES).count() == 0
