"""Connected components of an undirected graph, distributed.

Every node takes the smallest label among its neighbours and then the label of
its label, so long chains shrink by doubling.  Each round is written to shared
storage.  Rounds go on until no label changes; then all
but the last are deleted.  Labels are broadcast if there are ``FEW`` at most,
else joins deal them out, whatever Spark guesses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import FEW, dealt, passing, spool


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node of its component.

    Edges with a null end are left out; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a is not null and b is not null")
    with passing(spark) as result:
        both = spool(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
        labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
        labels = spool(labels.withColumn("old", F.lit(None).cast(labels.schema["label"].dataType)), "labels")
        mark = F.broadcast if labels.limit(FEW + 1).count() <= FEW else dealt
        while labels.where("old is null or label != old").limit(1).count():
            at = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
            best = both.join(mark(at), "other").groupBy("node").agg(F.min("theirs").alias("best"))
            now = labels.join(mark(best), "node").select("node", F.least("label", "best").alias("now"), F.col("label").alias("old"))
            root = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
            labels = spool(now.join(mark(root), "now").select("node", F.least("now", "far").alias("label"), "old"), "labels")
        return result(labels.select("node", "label"), "labels")
