"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a group-by and a join on DataFrames.  The least neighbour of a node is a pre-aggregated minimum, and both
sides of the join after it are read from written tables, so that adaptive execution can split the partition of a node
with a third of all edges.  Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.session import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, group): the least node of each component with an edge, for all its nodes."""
    spark = edges.sparkSession
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        after = _star(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), both=True)
        small = _star(after, both=False)
        new = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        dropped(spark, links, after)
        links = small
        if new == state:
            break
        state = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("group"))).distinct()


def _star(neighbours: DataFrame, both: bool) -> DataFrame:
    """Link the larger (large-star) or smaller (small-star) neighbours of each node to its least neighbour."""
    least = written(neighbours.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    seen = neighbours.join(least, neighbours.a == least.u)
    if both:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    star = written(out.where("a <> b").distinct(), "star")
    dropped(neighbours.sparkSession, least)
    return star
