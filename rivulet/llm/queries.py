"""Queries that apply each corpus operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, contamination, hostrules, licenses, secrets, simhash, tokenfile, toxicity, urls, warc
from rivulet.llm.oracles import ORACLES as ORACLES

#: Rules for URLs (domain and path).
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.joined("secrets", secrets.KINDS), 256).alias("base_sha256"), secrets.joined("secrets").alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"), "near_hit",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base_labels"), join("labels"), "score")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    docs = tokenfile.spool(tokenfile.checked(tokenfile.read(spark, out)), "token-places")
    return tokenfile.placed(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures_of(table(spark, sf_dir, "pages")))
    header = lambda k: F.element_at("headers", k)
    return found.select(
        F.expr("(id - 1) div 2").alias("page_id"), "uri", F.expr("coalesce(response_id div 2, -1)").alias("response_page_id"), "status",
        header("date").alias("header_date"), header("content-length").alias("header_length"), F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("payload_chars"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", *hostrules.MEASURES, "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels)).drop("text")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_secrets, op3_decontamination, op4_licenses, op5_token_file, op6_warc_revisits, op7_url_filter, op8_simhash, op9_host_rules, op10_toxicity)
}
