"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # As a table of its own, so that the join can split the rows of a node with very many neighbours.
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _unsettled(edges: DataFrame) -> bool:
    """Whether any id has two larger-to-smaller edges, or is an end of both kinds."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("ups")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("ups")))
    count = ends.groupBy("id").agg(F.sum("ups").alias("ups"), F.min("ups").alias("least"))
    return not count.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of ids to (id, root): for each id with an edge to another, the smallest id it is connected to.

    Alternates large and small star steps, each a partial aggregate and a join on thin rows, and writes the edges
    to the shared folder after each round, until every id has one edge, to its root; the number of rounds grows with the
    logarithm of the longest path, and edges that are stars need none. Edges with a null or to themselves count for
    nothing; an empty table gives an empty one.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while _unsettled(edges):
        edges = materialise(_small_star(_large_star(edges)).filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
