"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a long, b long) to (node, root): root is the smallest node id of the component.

    Rounds go on until one changes nothing. Nodes without a link have no row. Each round is written to the shared folder, so lineage stays short, and the round before is removed.
    Once the result is no longer read, released() removes the last one.
    Minima are partial aggregates joined back, so a node with very many links is not gathered in one task.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, staged(small.select("e.u", "e.v").filter("u <> v").distinct(), name)
        released(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    out.staged_path = edges.staged_path
    return out
