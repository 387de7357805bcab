"""The pipeline's stages keep all columns, and their decisions take effect."""

import brute
import corpus_pipeline
from tokenizers import Tokenizer


def test_stages(spark, docs, small_dir, paths):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, small_dir)
        assert d.columns == docs.columns, name
        d = spark.createDataFrame(d.collect(), d.schema)
    ids = [r["doc_id"] for r in d.collect()]
    assert len(ids) == len(set(ids)) and 103 not in ids and 108 not in ids and 104 not in ids and 110 in ids
    texts = {r["doc_id"]: r for r in d.collect()}
    assert "[secret]" in texts[110]["text"] and texts[110]["n_chars"] == len(texts[110]["text"])
    lib = Tokenizer.from_file(paths["byte_bpe_50k.json"])
    for r in corpus_pipeline.STAGES[-1][1](spark, d, small_dir).collect():
        assert r["round_trip"] and r["ids"] == lib.encode(texts[r["doc_id"]]["text"] or "", add_special_tokens=False).ids


def test_run(spark, small_dir):
    found = corpus_pipeline.run(spark, small_dir).collect()
    assert found and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert brute.sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
