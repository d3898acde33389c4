"""Connected components of an edge table, by contraction: every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node that it reaches.

    Each round hooks every root to its smallest neighbouring root, follows those pointers to
    their end, and replaces the edges' ends by their roots; edges inside a root vanish. A
    root's neighbours are only ever aggregated (min), never gathered, so a node with many
    edges costs one partial aggregate a task. Every join is of two plain tables, one of them
    with a row a root, so adaptive execution splits the rows of a root that holds very many.
    Rounds are logarithmic in the longest chain.
    Null ends are dropped; an empty table gives an empty one.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    live = stage(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    roots = stage(nodes.select("node", F.col("node").alias("root")), "roots")
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hooks = stage(hooks, "hooks")
        while True:
            higher = hooks.select(F.col("x").alias("up"), F.col("up").alias("upper"))
            jumped = stage(hooks.join(higher, "up").select("x", "up", "upper"), "jump")
            moved = jumped.where("upper <> up").limit(1).count()
            hooks = jumped.select("x", F.col("upper").alias("up"))
            if not moved:
                break
        roots = stage(roots.join(hooks.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        up_a, up_b = hooks.select(F.col("x").alias("a"), F.col("up").alias("ra")), hooks.select(F.col("x").alias("b"), F.col("up").alias("rb"))
        live = live.join(up_a, "a").join(up_b, "b").where("ra <> rb")
        live = stage(live.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots
