"""Connected components of an edge table: nodes hook to their smallest neighbour, trees are flattened, and what is between trees goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _flattened(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each larger end of a link hooks to its smallest neighbour: (node, root) once every node knows its tree's root.

    A round looks up the parents of all parents, so that their number grows with the logarithm
    of the depth. Tables are written before they are joined: each join has a shuffle of its own
    on either side, which can be split at a root with a third of all nodes.
    """
    up = scratch.save(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
    while True:
        over = up.select(F.col("node").alias("node_"), F.col("root").alias("root_"))
        new = up.select("node", "root").join(over, F.col("root") == F.col("node_"), "left")
        before, up = up, scratch.save(new.select("node", F.coalesce("root_", "root").alias("root"), F.col("root_").isNotNull().alias("moved")))
        scratch.drop(before)
        if up.where("moved").isEmpty():
            return up


def _lifted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between the trees that their ends are in, by the trees' roots."""
    of_u = roots.select(F.col("node").alias("u"), F.col("root").alias("x"))  # every larger end has hooked
    of_v = roots.select(F.col("node").alias("v"), F.col("root").alias("y"))
    ends = links.join(of_u, "u").join(of_v, "v", "left").select("x", F.coalesce("y", "v").alias("y")).where("x <> y")
    return ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v) -> (node, component): each node of an edge with the smallest node it reaches.

    Loops and null ends are ignored; no edges give an empty table. Rounds go on until no link
    is left between trees. Every round is a table in the shared folder.
    """
    links = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found: DataFrame | None = None
    while True:
        roots = _flattened(links, scratch)
        if found is None:
            now = roots.select("node", F.col("root").alias("component"))
        else:
            more = roots.select(F.col("node").alias("node_"), "root")
            old = found.join(more, F.col("component") == F.col("node_"), "left").select("node", F.coalesce("root", "component").alias("component"))
            now = scratch.save(old.unionByName(roots.select("node", F.col("root").alias("component"))))
        before, links = links, scratch.save(_lifted(links, roots))
        scratch.drop(before)
        found = now
        if links.isEmpty():
            break
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
