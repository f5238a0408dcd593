"""Connected components of an edge table, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.session import SHARE, checkpointed, gathered


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id of its component) for every id in edges (a, z).

    Each round takes the smallest label among the neighbours and then the label of that label, so paths halve; rounds
    end when no label changes. An id with many edges is reduced by partial minima before it is shuffled, and the joins
    are plain equi-joins that Spark splits when one side of a key is large. Only the number of edges and whether a label
    changed reach the driver. Up to ``SHARE`` rows of edges lie in one partition; labels, never more than those, then are
    broadcast and nothing is shuffled: a driver remembers every task and plan it had run, and rounds over small tables
    would otherwise be most of them. Edges are read twice.
    """
    parts = 2 * gathered(edges).count() // SHARE + 1
    there, back = F.struct("a", "z"), F.struct(F.col("z").alias("a"), F.col("a").alias("z"))
    both = checkpointed(edges.coalesce(parts).select(F.inline(F.array(there, back))).distinct().coalesce(parts)).coalesce(parts)
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("z")).alias("label")).coalesce(parts)).coalesce(parts)
    small = F.broadcast if parts == 1 else lambda df: df
    while True:
        own = labels.select("id", "label", F.col("label").alias("old"))
        near = both.join(small(labels), both.z == labels.id).select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        better = own.union(near).coalesce(parts).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        after = checkpointed(better.join(small(jump), better.label == jump.via, "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old").coalesce(parts)).coalesce(parts)
        labels = after.select("id", "label")
        if after.filter("label < old").isEmpty():
            return labels
