"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list; an empty list gives no rows.

    Each round points every node at the smallest id among itself and its
    neighbours, then replaces both ends of every edge by what they point at. Ids are
    expected to be hash-like (fingerprints), so a constant share of nodes
    vanishes each round. The minimum is a partial aggregate; the two joins
    read written tables on both sides, so a hub node with a third of all edges
    is split by the skew-join rule. Loops and null ends are ignored.
    """
    e = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                    .where("a is not null and b is not null and a != b").distinct())
    pointers: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("root")))
        pointers.append(p)
        e = cut_lineage(
            e.join(p.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
             .join(p.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
             .where("ra != rb")
             .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not pointers:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pointers[-1]
    for p in reversed(pointers[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = cut_lineage(p.join(later, "root", "left")
                          .select("node", F.coalesce("last", "root").alias("root")))
    return out
