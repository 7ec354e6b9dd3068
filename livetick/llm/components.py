"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetick.llm.common import cut, narrow


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of `edges` (a, b): the root is the smallest vertex of its component.

    In each round every vertex points to the smallest among itself and its neighbours, pointers are followed by
    doubling to where they end, a vertex smaller than all its neighbours, and edges are carried over to those. At most
    every second vertex is one, so rounds grow with the logarithm of the vertices, and doublings with that of the
    longest chain. Neighbours are reduced to a minimum before they are shuffled, so that a hub costs no more than
    other keys.
    """
    live = _cut(_tidy(edges))
    roots = _cut(_both(live).select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v")))
    while not live.isEmpty():
        low = _both(live).groupBy("a").agg(F.min("b").alias("_low"))
        to = _ends(_cut(low.select(F.col("a").alias("_v"), F.least("a", "_low").alias("_to"))))
        roots = _cut(roots.join(to, roots["root"] == to["_v"], "left").select("v", F.coalesce("_to", "root").alias("root")))
        moved = live.join(to, live["a"] == to["_v"]).select(F.col("_to").alias("a"), "b")
        moved = moved.join(to, moved["b"] == to["_v"]).select("a", F.col("_to").alias("b"))
        live = _cut(_tidy(moved))
    return roots


def _cut(df: DataFrame) -> DataFrame:
    return cut(narrow(df))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def _ends(to: DataFrame) -> DataFrame:
    """Follow pointers (_v, _to) to their ends; an end points to itself."""
    while True:
        next_to = to.select(F.col("_v").alias("_at"), F.col("_to").alias("_next"))
        to = _cut(to.join(next_to, to["_to"] == next_to["_at"]).select("_v", F.col("_next").alias("_to"), (F.col("_next") != F.col("_to")).alias("_moved")))
        if to.where("_moved").isEmpty():
            return to.select("_v", "_to")
