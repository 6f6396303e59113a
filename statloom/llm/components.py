"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): label is the smallest node it reaches.

    Alternates the large-star and small-star steps: each node hands its neighbours to the smallest
    one it knows. Every step aggregates before it shuffles, each round is written to the shared
    folder, and only a count and a checksum come back to tell that nothing changed any more.
    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    # A node points at its label only; labels are the ends that point at nothing.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return larger.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
