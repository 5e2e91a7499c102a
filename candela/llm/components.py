"""Connected components of an undirected graph.

Cases: an edge with a null end counts as no edge; an edge from a node to itself makes the node a component; repeated
edges, and edges in both directions, count once; no edges give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task takes at a time.
UNIT = 1_000_000


def stars(edges: DataFrame, a: str = "a", b: str = "b", unit: int = UNIT) -> tuple[DataFrame, int]:
    """(u, v) with v the smallest node that u is joined to within a unit of edges, and the number of units."""
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    units = max(1, -(edges.count() // -unit))

    def make():
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[y]
            return x

        def work(rows):
            if rows is None:
                return {"u": list(parent), "v": [root(x) for x in list(parent)]}
            for x, y in zip(rows["a"], rows["b"], strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            return None

        return work

    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).coalesce(units)
    return common.map_rows(given, make, "u long, v long", finish=True), units


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", unit: int = UNIT) -> DataFrame:
    """node, component (its smallest node) for each node of an edge (two 64-bit numbers).

    Units of edges, each of a bounded number, are contracted to stars on their own. The stars of several units are then
    joined in rounds: labels pass over the stars, and each label jumps to its own label; a round's labels are
    checkpointed, and the rounds end when no label has changed. Minima are taken before the shuffle, so a node with very
    many edges costs no task more than the others. Nothing but counts reaches the driver.
    """
    found, units = stars(edges, a, b, unit)
    found = common.checkpointed(found)
    if units == 1:
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = common.checkpointed(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = common.checkpointed(found.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"))
    fresh = lambda c, n: (F.col(c) + 0).alias(n)
    while True:
        passed = both.join(labels.select(fresh("node", "u"), "component"), "u").groupBy("v").agg(F.min("component").alias("passed"))
        new = labels.join(passed.select(fresh("v", "node"), "passed"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("passed", "component")).alias("component"))
        new = common.checkpointed(new)
        target = new.select(fresh("node", "target"), F.col("component").alias("further"))
        jumped = new.join(target, (F.col("component") + 0) == F.col("target"), "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        jumped = common.checkpointed(jumped)
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
