"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut_lineage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it reaches.

    Each round points every node at the smallest neighbour (large star, then
    small star), which ends after O(log^2 n) rounds. A node with very many
    neighbours is only ever a grouping key of a min() that combines before the
    shuffle, or the key of an inner join that adaptive execution can split.
    Each round is written to the shared folder, so a lost executor re-reads it.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e, name)
    state = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
