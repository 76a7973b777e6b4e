"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import cut

#: Hex digits of the md5 key that name a lane.
LANE_DIGITS = 3


def md5_key(seed: int, *parts: Column) -> Column:
    """A shuffle key that any engine can make: md5 of 'seed:part|part'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *(p.cast("string") for p in parts))).cast("binary"))


def ranked(df: DataFrame, by: list[str], key: str, *ties: str) -> DataFrame:
    """df with rk (from 1, by the md5 key, then ties) and n (rows of the group).

    Rows are ranked within lanes of the key, and lanes get the count of the lanes before them, so a group
    that holds most rows still spreads over the lanes.
    """
    lane = F.substring(key, 1, LANE_DIGITS)
    lanes = df.groupBy(*by, lane.alias("_lane")).agg(F.count(F.lit(1)).alias("_m"))
    ahead = Window.partitionBy(*by).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select(*by, "_lane", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_m").over(Window.partitionBy(*by)).alias("n"))
    within = Window.partitionBy(*by, "_lane").orderBy(key, *ties)
    own = df.withColumn("_lane", lane).withColumn("_rk", F.row_number().over(within))
    return own.join(lanes, [*by, "_lane"]).withColumn("rk", F.col("_ahead") + F.col("_rk")).drop("_lane", "_ahead", "_rk")


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each value, the sum of it over the rows of the group so far (its own included) and over the whole group (name_total).

    Rows are range-partitioned by group and order. A group that lies in several partitions gets the sums of those before; there are
    at most as many such pieces as partitions, so they are broadcast. No group has to fit into a task.
    """
    keyed = df.select("*", *(v.alias(f"_v_{n}") for n, v in values.items()))
    parts = cut(keyed.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = cut(parts.groupBy(*by, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values)))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Pieces of groups that have several; and the totals of the others, which have one.
    pieces = sums.withColumn("_pieces", F.count(F.lit(1)).over(group))
    several = pieces.where("_pieces > 1").select(*by, "_part", *(F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_a_{n}") for n in values), *(F.sum(f"_s_{n}").over(group).alias(f"_t_{n}") for n in values))
    own = Window.partitionBy(*by, "_part")
    within = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("*", *(F.sum(f"_v_{n}").over(within).alias(f"_w_{n}") for n in values), *(F.sum(f"_v_{n}").over(own).alias(f"_o_{n}") for n in values))
    there = several.withColumnsRenamed({c: f"_g_{c}" for c in [*by, "_part"]})
    same = F.col("_part") == F.col("_g__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    met = rows.join(F.broadcast(there), same, "left")
    out = [(F.col(f"_w_{n}") + F.coalesce(f"_a_{n}", F.lit(0))).alias(n) for n in values] + [F.coalesce(f"_t_{n}", f"_o_{n}").alias(f"{n}_total") for n in values]
    return met.select(*df.columns, *out)
