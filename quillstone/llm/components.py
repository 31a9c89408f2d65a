"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links what is next to a node to the least node there (itself included): the larger neighbours, or the smaller ones and itself.

    edges: (a, b) with a > b. The least neighbours are summed before they are shuffled and written, so that the join that
    follows has a plain exchange on either side and Spark can split a node with many neighbours.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # b's larger neighbour a goes to the least node beside b; b itself gets its link where it is the larger one
        out = edges.select(F.col("b").alias("node"), F.col("a").alias("next")).join(least.withColumnRenamed("a", "node"), "node").select(F.col("next").alias("a"), F.col("m").alias("b"))
    else:
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable.

    Rounds of large and small stars (Kiveris and others, 2014) run until a round changes nothing. Loops, repeated and
    reversed edges are allowed; an empty graph has no components.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = written(edges, "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(edges)
    while before[0]:
        edges = written(_star(edges, True), "edges")
        edges = written(_star(edges, False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
