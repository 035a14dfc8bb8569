"""Connected components of an edge table by random hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the same for all of a component.

    In a round every node points to itself or that neighbour whose hash is least; the pointers are jumped once,
    and the edges are rewritten by them. The hashes order the nodes at random, so few are local minima whatever
    the graph: the rounds are logarithmic in its size also on long chains (a path of 1,000 edges takes 7), and as
    the order stays, a star's hub is its least node after one round and the star is gone after two. Neighbours are pre-aggregated, so a hub is one row a task, and the joins need no key's rows
    together. Every round cuts its lineage with tables in the shared folder.
    """
    both = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not both.isEmpty():
        near = both.select(F.col("a").alias("node"), rank("b").alias("other")).unionAll(both.select(F.col("b").alias("node"), rank("a").alias("other")))
        step = near.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least(rank("node"), F.col("other")).getField("v").alias("to"))
        ahead = step.select(F.col("node").alias("at"), F.col("to").alias("further"))
        step = written(step.join(ahead, F.col("to") == F.col("at")).select("node", F.col("further").alias("to")), "step")
        first = found is None
        if first:
            found = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("at"), "to")
            before, found = found, written(found.join(moved, found["root"] == moved["at"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            dropped(before)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        moved = both.join(left, "a").join(right, "b").where("a_to <> b_to")
        before, both = both, written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        dropped(before)
        if not first:  # the first answer is a view of the first step
            dropped(step)
    return both.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
