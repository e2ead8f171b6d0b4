"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.session import written


def _order(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges(a, b)``; the component is its smallest id.

    ``edges`` is read twice, so it should be a written table.

    In each round every node points to the first of its neighbours and itself in the order of a
    hash; the links between different targets are the graph of the next round. As the order is
    random, a constant share of the nodes goes each time whatever the ids. What a round needs is
    written; nothing but an emptiness test comes to the driver. Repeated links, links in both
    directions and links of a node to itself do no harm; rows with a null are passed over.
    """
    ids = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    ids = ids.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ids.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = _links(ids)
    links, nodes = written(links, "links"), written(nodes, "nodes")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        first = both.groupBy("a").agg(F.min(_order("b")).alias("near"))
        target = F.least(F.col("near"), _order("a")).getField("id")
        step = written(first.select(F.col("a").alias("id"), target.alias("to")), "step")
        steps.append(step)
        a = step.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        b = step.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(a, "a").select("b", "to_a").join(b, "b")
        links = written(_links(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "links")
    labels = nodes.select("id", F.col("id").alias("root"))
    for step in steps:
        to = step.select(F.col("id").alias("root"), "to")
        labels = labels.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    labels = written(labels, "roots") if steps else labels
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(written(least, "components"), "root").select("id", "component")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


class Forest:
    """Union-find over 0..n-1 inside one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j
