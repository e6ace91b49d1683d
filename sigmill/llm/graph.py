"""Connected components by contraction, on shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _flatten(parents: DataFrame) -> DataFrame:
    """Follow v -> p (p < v) to the end, doubling the reach each time."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
        stepped = materialize(parents.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "graph-parents")
        parents = stepped.select("v", "p")
        if stepped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest.

    Each round hooks every node onto its smallest neighbour below it, follows
    the hooks to their ends and contracts the edges, at least halving the
    nodes that still have edges. Aggregates combine before shuffling, and
    joins are between written tables, so a hub's edges can be split.
    Self-links and nulls are dropped; no edges give no rows.
    """
    e = materialize(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "graph-edges")
    found = None
    while found is None or not e.isEmpty():
        hooks = _flatten(materialize(e.groupBy("v").agg(F.min("u").alias("p")), "graph-hooks"))
        if found is None:
            found = hooks
        else:
            on = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
            found = materialize(found.join(on, "p", "left").select("v", F.coalesce("q", "p").alias("p")).unionByName(hooks), "graph-found")
        a, b = hooks.select(F.col("v").alias("u"), F.col("p").alias("pu")), hooks.select("v", F.col("p").alias("pv"))
        moved = e.join(b, "v", "left").join(a, "u", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y")).where("x <> y")
        e = materialize(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "graph-edges")
    roots = found.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()
    return found.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(roots)
