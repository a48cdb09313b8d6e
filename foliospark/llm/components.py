"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join on a node; every round writes its edges to
the shared folder, so lineage stays short and nothing reaches the driver but whether
the edges are stars by now, each around its component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _minima(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Per node the smallest of itself and its neighbours; written, so that the
    join with the edges reads plain exchanges and a hub's edges can be split."""
    return ws.stage(edges.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m")), name)


def _stars(links: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour, which has none, or none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``edges`` (a long, b long), in any direction; returns ``node, root``: for each
    node that has an edge to another, the smallest node it reaches (roots too)."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = ws.stage(links, f"{name}-links-0")
    turn = 0
    while not _stars(links):
        turn += 1
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minima(both, ws, f"{name}-large-{turn}"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.stage(large.where("a <> b").distinct(), f"{name}-star-{turn}")
        small = large.join(_minima(large, ws, f"{name}-small-{turn}"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        links = ws.stage(small.where("a <> b").distinct(), f"{name}-links-{turn}")
        for part in (f"{name}-large-{turn}", f"{name}-small-{turn}", f"{name}-star-{turn}", f"{name}-links-{turn - 1}"):
            ws.drop(part)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
