"""Connected components of links, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from searchlab.sources.staging import stage


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").select("node", F.least("node", "least").alias("least"))
    return (
        both.filter("b > a")
        .join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    least = _least(edges, "a", "b")
    tied = edges.join(least, F.col("a") == F.col("node"))
    return (
        tied.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node it reaches.

    Links of a node with itself and null ends are ignored; no links give no rows. Rounds
    of large and small stars go on until nothing changes; each is written, so that none
    depends on the ones before. A node with very many links is combined before the
    shuffle, and its links are split among tasks by the skew handling of joins.
    """
    edges = links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges, last = stage(edges, "links"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = state
        edges = stage(_small_star(_large_star(edges)), "links")


def same_id_links(features: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) between the nodes of different sets that rows of one id have.

    ``features``: doc_id, n, set_key; ``sets``: set_key, node. None where no id repeats with another set.
    """
    rows = features.filter("n > 0 and doc_id is not null").select("doc_id", "set_key")
    several = rows.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low != high")
    several = stage(several.select("doc_id", "low"), "repeated_ids")
    if several.isEmpty():
        return None
    nodes = sets.select("set_key", "node")
    return (
        rows.join(several, "doc_id").join(nodes.withColumnRenamed("node", "a"), "set_key")
        .join(nodes.select(F.col("set_key").alias("low"), F.col("node").alias("b")), "low").select("a", "b").distinct()
    )
