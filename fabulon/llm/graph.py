"""Connected components of link tables, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulon.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id in a link.

    Alternating large-star and small-star rounds (Kiveris et al.): each points ids at smaller
    ones until every component is a star. Links with null or equal ends are passed over. Tables
    are cut from their lineage by checkpoints in the shared folder.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = checkpointed(edges)
    # Done when all are stars: each id points at one other, and none points at an id that points on.
    while edges.groupBy("u").count().filter("count > 1").limit(1).count() or edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        edges = checkpointed(small)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
