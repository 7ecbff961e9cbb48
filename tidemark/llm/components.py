"""Connected components of a table of links, by large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize


def join_salted(rows: DataFrame, one: DataFrame, key: str, by: str, salt: int = 16) -> DataFrame:
    """`rows` joined with `one` (one row a key): a key with very many rows is dealt by `by` to `salt` tasks' work."""
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salt))).join(copies, [key, "_salt"]).drop("_salt")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one link, which leads to a centre."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = roles.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out = 1 AND in = 1)")
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node in `links` (a, b); comp is the smallest node reachable.

    A round replaces each node's links by links to the smallest neighbour, so components turn
    into stars in about log n rounds. Minima are pre-aggregated and joined back by salted keys,
    so a node with very many links needs no task that holds them all. The rounds end when all are stars.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    while not _is_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_salted(both, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_salted(large, down, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        edges = materialize(small.filter("u <> v").distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())
