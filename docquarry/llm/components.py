"""Connected components of an edge table, without collecting any of it.

Each round every vertex points to its smallest neighbour (itself, if smaller),
pointers are followed once more, and edges are drawn anew between the vertices
pointed to.  Edges inside a group vanish, so the rounds are logarithmic in the
longest path; stars, the common case, take one.  All steps are equi-joins and
minima with map-side combining; the centres of large stars are broadcast apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges(a, b)``; label is the smallest id of the component."""
    left = written(edges.select("a", "b").filter("a <> b"), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("rows")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"), "rows")
        first = written(first, "first")
        further = first.select(F.col("id").alias("to"), F.col("to").alias("then"), "rows")  # at most as many point to it
        pointers = written(spread_join(first.drop("rows"), further, ["to"]).select("id", F.col("then").alias("to")), "pointers")
        at = lambda c: pointers.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        degree = first.select(F.col("id").alias("a"), "rows")
        drawn = spread_join(left, written(at("a").join(degree, "a"), "degrees"), ["a"]).join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = written(drawn.filter("a <> b").distinct(), "edges")
        if labels is None:
            labels = pointers.select("id", F.col("to").alias("label"))
        else:
            moved = pointers.select(F.col("id").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("label")).limit(0)
    return labels
