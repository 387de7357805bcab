import sys
from pathlib import Path
import random

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
LONG = " ".join(f"w{i % 997}" for i in range(20_000))


def rows_for_tests():
    """Documents with nulls, empty, odd and very long texts, copies, near copies, secrets, phrases and repeated rows."""
    r = random.Random(7)
    base = [" ".join(r.choice(["river", "stone", "tree", "cloud", "the", "of", "Été", "straße"]) + str(r.randrange(40)) for _ in range(r.randrange(3, 120))) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100, None), (101, ""), (102, " \n\t "), (103, LONG), (104, base[0]), (105, base[0] + " extra"), (106, "日本語 テスト é ́ <|endoftext|> don't 'S ½²"), (107, "a"), (108, "two words")]
    out += [(110, 'x password: "abc12345" PassWord=short1 token=secret=abcdefgh12 api_key := zzz AKIA' + "A1" * 8 + " " + "0f" * 20)]
    out += [(111, "account: jane\nkey Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1\n\n\nfar away Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9"), (112, "Under the MIT License. under, the-mit license; CC BY-NC x apache license, version 2.0 GPL-3.0-or-later copyright")]
    out += [(120, base[3]), (121, base[3]), (121, base[3]), (130, "line\nline\n\nline\n a b c a b c a b c " + "$#" * 5)]
    return out


@pytest.fixture(scope="session")
def rows():
    return rows_for_tests()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, [1], "y", 0.5, "z") for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, fp int, secrets array<int>, host string, toxicity double, file string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def paths():
    import public_tokenizers

    return {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.fixture(scope="session")
def small_dir(docs, spark, tmp_path_factory):
    """A folder of tables as the queries read them."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "Stone1 river2 " + LONG[:200]), (2, "two words"), (3, None), (None, "a"), (4, "w5 w6 w7 w8 w9 w10 w11 w12 w13"), (4, "w5 w6 w7 w8 w9 w10 w11 w12 w13")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(25)] + [(3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int").write.parquet(f"{d}/labels.parquet")
    urls = [None, "", "no scheme", "HTTP://Example.COM/en/7x?q#f", "http://a.b.net/de/9", "https://example.net/de/8/1", "x://net", "http://www.notnet/de/1", "http://org/es/?a", "http://h.example.com/en/1#/x"]
    spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)] + [(20, urls[4], None), (20, urls[4], None)], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d
