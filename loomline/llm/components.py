"""Connected components by hooking and contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import pin, release


def components(edges: DataFrame) -> DataFrame:
    """`edges`: (a, b), long ids, in any direction, repeated or not. Returns (id, component): every id that has an edge, and the
    smallest id that can be reached from it.

    Each round every node hooks to its smallest neighbour if that is smaller, hooks are followed twice, and the graph is
    contracted to the nodes hooked to. Hooks only lead to smaller ids of the same component, so the node left of a component is its
    smallest. Minima are taken before the shuffle, and the joins on hooks are plain equi-joins that adaptive execution can
    split where one hub holds much of the graph. Every round at least halves the nodes that still have edges. A round's
    tables are deleted once the next one's are written.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    edges = pin(ordered(edges), "edges")
    labels = None
    while not edges.isEmpty():
        direct = pin(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "hooks")
        hooks = direct
        for _ in range(2):
            further = hooks.select(F.col("id").alias("id2"), F.col("to").alias("to2"))
            hooks = hooks.join(further, F.col("to") == F.col("id2"), "left").select("id", F.coalesce("to2", "to").alias("to"))
        hooks = pin(hooks, "followed")
        contracted = edges
        for side in ("a", "b"):
            mapped = hooks.select(F.col("id").alias("hid"), F.col("to").alias("hto"))
            contracted = contracted.join(mapped, F.col(side) == F.col("hid"), "left").select(
                *[(F.coalesce("hto", c) if c == side else F.col(c)).alias(c) for c in ("a", "b")]
            )
        before = labels
        if labels is None:
            # a node that hooks to none is its component's smallest so far
            nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            labels = nodes.join(hooks, "id", "left").select("id", F.coalesce("to", "id").alias("component"))
        else:
            mapped = hooks.withColumnRenamed("id", "hid")
            labels = labels.join(mapped, F.col("component") == F.col("hid"), "left").select(
                "id", F.coalesce("to", "component").alias("component")
            )
        labels = pin(labels, "labels")
        rest = pin(ordered(contracted), "edges")
        release(edges, direct, hooks, *([before] if before is not None else []))
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    release(edges)
    return labels
