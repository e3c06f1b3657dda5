"""Connected components of a link table, by contraction; no link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """(node, comp) for every node of `links`; comp is the same for two nodes iff a path joins them.

    Each round sends every node to its smallest neighbour (or itself) and rewrites the links between the
    targets; links inside a target vanish. Node values are expected to be hashes, so a long chain shrinks by
    a constant factor a round. Nulls and self-links are ignored.
    """
    edges = materialize(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col("u") < F.col("v")).distinct(), f"{tag}-edges"
    )
    nodes = None
    for step in range(60):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        target = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("t")), f"{tag}-target{step}")
        if nodes is None:
            nodes = target.select(F.col("u").alias("node"), F.col("t").alias("comp"))
        else:
            hop = target.select(F.col("u").alias("comp"), F.col("t"))
            nodes = nodes.join(hop, "comp", "left").select("node", F.coalesce("t", "comp").alias("comp"))
        moved = (
            edges.join(target.select("u", F.col("t").alias("tu")), "u")
            .join(target.select(F.col("u").alias("v"), F.col("t").alias("tv")), "v")
            .select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
            .filter(F.col("u") < F.col("v"))
            .distinct()
        )
        edges = materialize(moved, f"{tag}-edges{step}")
        if edges.isEmpty():
            return nodes
    raise RuntimeError("components did not converge")
