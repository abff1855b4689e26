"""Connected components of an edge table by repeated contraction.

Every node points to its smallest neighbour, edges are rewritten to the nodes pointed
at, and loops fall away, until no edge is left. Each step is a grouped minimum, combined
before its shuffle, and joins against one row per node; so a node with very many
edges costs one row per task. Every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.session import via_table


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root is one node of its component.

    ``edges`` has the columns ``a`` and ``b``; nulls and loops are ignored, repeated
    edges count once. No edges give an empty table.
    """
    live = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    live = via_table(live, "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    found = nodes.select("node", F.col("node").alias("root"))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        point = via_table(
            both.groupBy(F.col("a").alias("from"))
            .agg(F.min("b").alias("to"))
            .select("from", F.least("from", "to").alias("to")),
            "pointers",
        )
        found = via_table(
            found.join(point, found.root == point["from"], "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "roots",
        )
        heads = point.select(F.col("from").alias("a"), F.col("to").alias("u"))
        tails = point.select(F.col("from").alias("b"), F.col("to").alias("v"))
        live = via_table(
            live.join(heads, "a")
            .join(tails, "b")
            .where("u <> v")
            .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
            .distinct(),
            "edges",
        )
    return found
