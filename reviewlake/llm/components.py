"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import released, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (64-bit), the root the component's smallest node.

    A large star joins a node's larger neighbours to its smallest one, a small star
    its smaller ones; both keep components and turn them into stars in a few rounds
    (Kiveris et al., Connected components in MapReduce and beyond). Every round is
    written, so lost executors never repeat earlier rounds. Minima are combined
    before the shuffle; nothing reaches the driver but the edges' count and checksum.
    Loops and repeated edges are ignored, and no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    current = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    seen = None
    for _ in range(MAX_ROUNDS):
        current = written(current, "edges")
        now = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if now == seen or not now.n:
            released(edges.sparkSession)
            return current.select(a.alias("node"), b.alias("root")).union(current.select(b, b)).distinct()
        seen = now
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        current = small.union(least.select("a", F.col("m").alias("b"))).distinct()
    raise RuntimeError("components did not settle")
