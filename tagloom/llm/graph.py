"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u; partial minima are sent, so a hub costs one row for each task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a and b); a component is named by its smallest node.

    Alternates two steps until nothing changes: every node points its larger neighbours to its smallest one, then every
    node points itself and its smaller neighbours to the smallest. Stars of any size end after one round and paths
    after a logarithmic number. Each round is a written table, so lost executors never replay earlier rounds. Links to
    itself and repeated links are allowed; nulls are not nodes; no links give no rows.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null")
        .distinct()
    )
    edges = written(edges)
    state = None
    while True:
        both = edges.where("u <> v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # larger neighbours of u, and u itself, go to the smallest of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.where("u = v")).where("u >= v").distinct()
        down = _least(large)
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(
            small.unionByName(down.select("u", F.col("m").alias("v")))
            .unionByName(least.select(F.col("m").alias("u"), F.col("m").alias("v")))
            .where("u >= v")
            .distinct()
        )
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
