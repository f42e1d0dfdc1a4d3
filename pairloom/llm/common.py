"""What several training-data operators share: the shared folder, saved tables, word splitting, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.runtime import discard, saved, shared_dir

__all__ = ["SPACE", "components", "discard", "saved", "shared_dir", "small"]

#: Word separators of the word-based operators: blank, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without an argument splits at the same six bytes.
SPACE = b" \t\n\x0b\x0c\r"


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a saved table) with a broadcast hint if it has at most ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row ``(node, component)`` per linked node, component = smallest node.

    Alternating large-star and small-star rounds over the edge list (u > v), each written to the shared folder: every node's
    larger neighbours move to its smallest neighbour, then every node and its smaller neighbours do. Minima combine
    map-side, so a node with very many links is no hot spot. Ends when a round changes nothing. No links: no rows.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u")
        moved = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        last, edges = edges, saved(moved.where("u <> v").distinct(), "edges")
        now = mark(edges)
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
