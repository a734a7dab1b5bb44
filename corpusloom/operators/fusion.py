"""Rank fusion over long form lists: (list_no, id, score), higher is better."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECIPROCAL, RELATIVE = "reciprocal", "relative"
K = 60.0


def ranked(lists: list[DataFrame]) -> DataFrame:
    """One long DataFrame of several (id, score), with list_no and rank0 (by score, then id)."""
    if not lists:
        raise ValueError("no list to fuse")
    parts = [x.select(F.lit(i).alias("list_no"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score")) for i, x in enumerate(lists)]
    order = Window.partitionBy("list_no").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank0", F.row_number().over(order) - 1)


def reciprocal(long: DataFrame) -> DataFrame:
    """id, fused: the sum of 1 / (60 + rank0) over the lists."""
    return long.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(K) + F.col("rank0"))).alias("fused"))


def relative(long: DataFrame, weights: list[float]) -> DataFrame:
    """id, fused: the weighted sum of scores scaled to 0 to 1 within their list; a list of equal scores counts 1 throughout."""
    bounds = Window.partitionBy("list_no")
    low, high = F.min("score").over(bounds), F.max("score").over(bounds)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    weight = F.element_at(F.lit([float(w) for w in weights]), F.col("list_no") + 1)
    return long.withColumn("part", scaled * weight).groupBy("id").agg(F.sum("part").alias("fused"))


def fuse(lists: list[DataFrame], how: str = RECIPROCAL, weights: list[float] | None = None) -> DataFrame:
    """id, fused. The number of weights must be that of the lists, else the result is empty."""
    long = ranked(lists)
    if how == RECIPROCAL:
        return reciprocal(long)
    if how != RELATIVE:
        raise ValueError(f"unknown fusion {how!r}")
    weights = [1.0 / len(lists)] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        return reciprocal(long).limit(0)
    return relative(long, weights)


def with_rank(fused: DataFrame) -> DataFrame:
    """rank0 by fused score (to twelve digits, so that the order of a sum doesn't matter), ties by id; for the few candidates that fusion leaves."""
    return fused.withColumn("rank0", F.row_number().over(Window.orderBy(F.desc(F.round("fused", 12)), "id")) - 1)
