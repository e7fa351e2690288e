"""Connected components of a graph given as links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factsheet.llm.common import checkpointed, spread_join


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (``u``, ``v``): the smallest node reachable.

    Alternating stars: each node ties its larger neighbours to the smallest it knows, then its smaller ones,
    until nothing changes. The number of links never grows beyond nodes plus links, the rounds grow with the
    logarithm of a component's length, and each round is kept in the shared folder. Rows of a node with many
    links meet in one task only as partial minima.
    """

    def tied(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return spread_join(pairs, least, "u", ["v"], copies=8)

    def star(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tied(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        down = tied(large)
        small = down.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.union(down.select("u", F.col("m").alias("v"))).filter("u > v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    edges = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = mark(edges)
    for _ in range(rounds if before[0] else 0):
        edges = checkpointed(star(edges))
        if (now := mark(edges)) == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
