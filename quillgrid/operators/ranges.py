"""Counts of points in ranges, by ranks instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stored


def count_within(points: DataFrame, value: str, ranges: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """How many points each key's ranges hold, ends included, as key and n; keys that hold none have no row.

    Points and ends are sorted together once, by ranges of values: at equal values lower ends come before points and upper
    ends after them. A running sum, within parts and over their totals, counts the points before each end. Equal points are
    one row, and equal ends are told apart by their keys, so no value is too much for a task.
    """
    at = points.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w")).select("v", F.lit(1).alias("side"), F.lit(None).cast(ranges.schema[key].dataType).alias("key"), "w")
    # A null end and an end below the other hold nothing; zeros of both signs are one value.
    fine = ranges.where(F.col(low) <= F.col(high))
    ends = fine.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct((F.col(c) + F.lit(0)).alias("v"), F.lit(side).alias("side")) for c, side in ((low, 0), (high, 2))])).alias("e")).select("e.v", "e.side", "key", F.lit(0).cast("long").alias("w"))
    order = ["v", "side", "key"]
    placed = stored(at.unionByName(ends).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)  # as in with_fid
    totals = placed.groupBy(part.alias("_part")).agg(F.sum("w").alias("_w"))
    before = totals.select("_part", (F.sum("_w").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_w")).alias("_before"))  # one row a partition
    running = placed.withColumn("_part", part).withColumn("_n", F.sum("w").over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)))
    ranked = running.where("side <> 1").join(F.broadcast(before), "_part").select("key", F.when(F.col("side") == 2, 1).otherwise(-1).cast("long").alias("sign"), (F.col("_before") + F.col("_n")).alias("n"))
    return ranked.groupBy(F.col("key").alias(key)).agg(F.sum(F.col("sign") * F.col("n")).alias("n")).where("n > 0")
