"""Percentiles from signed logarithmic buckets.

A value x > 0 falls into bucket ceil(log_g(x)) with g = (1 + a) / (1 - a); the
middle of a bucket, 2 g^i / (g + 1), is within the relative error a of every value
in it.  Negative values use the same buckets of |x| with the sign, values of
magnitude below ``min_value`` the bucket zero.  A sketch is the table of bucket
counts: sketches of partitions, days or groups are combined by adding counts, and
a percentile of the sum carries the same guarantee.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gamma(rel_error: float) -> float:
    if not 0 < rel_error < 1:
        raise ValueError("rel_error must lie between 0 and 1")
    return (1 + rel_error) / (1 - rel_error)


def bucket_of(value: Column, rel_error: float, min_value: float = 1e-9) -> Column:
    """The bucket of a value: one integer whose order is the order of the values.

    Positive values have positive numbers, negative ones negative, values around
    zero 0.  Null, NaN and infinite values have no bucket (null).
    """
    v = value.cast("double")
    base = math.floor(math.log(min_value) / math.log(gamma(rel_error))) - 1
    place = F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma(rel_error)))).cast("int") - F.lit(base)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, F.when(F.abs(v) < min_value, F.lit(0)).when(v > 0, place).otherwise(-place)).cast("int")


def value_of(bucket: Column, rel_error: float, min_value: float = 1e-9) -> Column:
    """The value that stands for a bucket."""
    g = gamma(rel_error)
    base = math.floor(math.log(min_value) / math.log(g)) - 1
    middle = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.abs(bucket) + F.lit(base))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * middle)


def sketch(df: DataFrame, keys: list[str], value: str, rel_error: float = 0.01, min_value: float = 1e-9) -> DataFrame:
    """The sketch (keys, bucket, n) of ``value`` per group.

    A group key may hold any share of the rows: its counts are added up before the
    shuffle, so that at most one row per bucket and input partition is moved.
    Null keys form groups of their own.  Values that have no bucket are left out; a
    group of such values only, and an empty table, give no rows.
    """
    rows = df.select(*keys, bucket_of(F.col(value), rel_error, min_value).alias("bucket")).where("bucket is not null")
    return rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counts of matching buckets: the sketch of the coarser groups ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], pcts: list[int], rel_error: float = 0.01, min_value: float = 1e-9) -> DataFrame:
    """(keys, pct, value, n) of each group: the value of nearest rank, within ``rel_error`` of it.

    ``rel_error`` and ``min_value`` must be those of the sketch.  Ranks count from
    one: the percentile p of n values is the ceil(p n / 100)-th, the first for p = 0.
    A group's buckets, of which there are at most a few thousand however many rows
    it has, are ordered in one window.
    """
    w = Window.partitionBy(*keys)
    below = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sketches.select(*keys, "bucket", F.sum("n").over(below).alias("_upto"), F.sum("n").over(w).alias("_total"), "n")
    ranks = [F.struct(F.lit(p).cast("int").alias("pct"), F.greatest(F.lit(1), F.ceil(F.col("_total") * p / F.lit(100.0))).alias("rank")) for p in pcts]
    run = run.withColumn("_p", F.explode(F.array(*ranks)))
    hit = (F.col("_upto") >= F.col("_p.rank")) & (F.col("_upto") - F.col("n") < F.col("_p.rank"))
    return run.where(hit).select(*keys, F.col("_p.pct").alias("pct"), value_of(F.col("bucket"), rel_error, min_value).alias("value"), F.col("_total").alias("n"))
