"""From raw documents to token ids in five stages, each one operator of ``rivulet.llm``.

All stages but the last return the columns of the documents.  Each works on all
that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, contamination, secrets, similar, toxicity
from rivulet.llm.common import fresh, spool

#: Documents scored so high or higher go.
TOXIC = 0.7
#: Documents with windows of so many benchmark items, or more, go.
LEAKS = 1


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    mark = fresh(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.train(docs, labels), column=mark)
    return scored.where(F.col(mark) < TOXIC).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more; SimHash and its anchors first, then all that they do not reach."""
    return similar.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mark = fresh(docs, "items")
    marked = contamination.mark(docs, items, mark)
    return marked.where(F.size(F.array_distinct(mark)) < LEAKS).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents; each one's result is written to shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages learn a model, hash shingles and merge symbols; SQL has no form for them.  tests/llm compares with plain Python.
ORACLE_SQL = None
