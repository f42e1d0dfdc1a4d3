"""Exact places in an order over large groups: no task ever holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.plans.runtime import saved


def ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt to ranges of ``by`` and sorted in each, with ``part``, the number of the range; saved, so that ranges stay as they are."""
    return saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "ranges")


def values_at(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``group``, n and, for every name in ``places``, the value at that place among the group's non-null values in ascending order.

    A place is a function of n that counts from 0. Equal values become one row with a count; those are dealt to ranges of (group, value). A running sum
    over the ranges (a row for each range and group in it) tells which of them hold the wanted places; only these are searched.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = ranges(counted, ["g", "v"])
    sizes = dealt.groupBy("g", "part").agg(F.sum("c").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"before": before, "n": F.sum("m").over(W.partitionBy("g"))})
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), at(F.col("n")).cast("long").alias("at")) for k, at in places.items()])
    here = F.filter(wanted, lambda w: (w["at"] >= F.col("before")) & (w["at"] < F.col("before") + F.col("m")))
    hit = sizes.withColumn("here", here).where(F.size("here") > 0).select(F.col("g").alias("g0"), F.col("part").alias("p0"), "before", "n", "here")
    found = dealt.join(hit, F.col("g").eqNullSafe(F.col("g0")) & (F.col("part") == F.col("p0")))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("g", "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumn("upto", upto).withColumn("name", F.explode(F.filter("here", lambda w: (w["at"] < F.col("upto")) & (w["at"] >= F.col("upto") - F.col("c")))["name"]))
    return found.groupBy(F.col("g").alias(group)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])


def first_in_order(rows: DataFrame, by: list[str], room: DataFrame) -> DataFrame:
    """The first ``room`` rows (a table of one number) in the order of all of ``by``, which tells all rows apart.

    Ranges that lie before the limit are taken whole, only the one that holds it is ranked.
    """
    dealt = ranges(rows, by)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("m"))  # a row per range
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).crossJoin(F.broadcast(room.toDF("room"))).where("before < room").select(F.col("part").alias("p0"), (F.col("before") + F.col("m") <= F.col("room")).alias("whole"), (F.col("room") - F.col("before")).alias("left"))
    here = dealt.join(F.broadcast(sizes), F.col("part") == F.col("p0"))
    edge = here.where("not whole").withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*by))).where("rank <= left")
    return here.where("whole").select(*rows.columns).unionByName(edge.select(*rows.columns))
