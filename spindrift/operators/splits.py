"""Drawing and splitting of labelled rows.

A draw takes the first rows of each group in the order of a hash of their id, so it
is the same on every run and without replacement.  No group is ever sorted in one
task: rows are counted per slice of hash values, and only the slice in which the
wanted number is reached is put into order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash that make up a slice.
SLICE_BITS = 12


def draw(rows: DataFrame, keys: Sequence[str], share: float, least: int = 1, seed: int = 0) -> DataFrame:
    """``rows`` with ``drawn``: whether the row is among the ``share`` of its group, rounded half to even, at least ``least``.

    Rows that repeat an id count one by one.  Null keys form groups of their own.
    """
    h = F.xxhash64("row_id", F.lit(seed))
    work = rows.withColumns({"_h": h, "_slice": F.shiftright(h, 64 - SLICE_BITS)}).withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    counts = work.groupBy(*names, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_slice"))
    total = F.sum("_n").over(Window.partitionBy(*names))
    plan = counts.select(*names, "_slice", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.greatest(F.lit(least), F.bround(total * F.lit(share), 0)).cast("long").alias("_want"))
    met = work.join(plan, [*names, "_slice"])
    open_ = (F.col("_before") < F.col("_want")) & (F.col("_upto") > F.col("_want"))
    within = F.row_number().over(Window.partitionBy(*names, "_slice").orderBy("_h", "row_id"))
    settled = met.where(~open_).withColumn("drawn", F.col("_upto") <= F.col("_want"))
    rest = met.where(open_).withColumn("drawn", F.col("_before") + within <= F.col("_want"))
    return settled.unionByName(rest).select(*rows.columns, "drawn")


def size_grid(n: int, least: int = 10, points: int = 8) -> list[int]:
    """Sizes from ``least`` to ``n`` in equal ratios, rounded, each once."""
    if n <= least:
        return [n]
    return sorted({round(least * (n / least) ** (i / (points - 1))) for i in range(points)})


def split_sides(rows: DataFrame, label: str, mode: str, share: float = 0.5, n_shared: int = 0, seed: int = 0, given: Sequence = ()) -> DataFrame:
    """``rows`` with ``side``, ``source`` or ``target``.

    ``random``: a share of all rows is the source.  ``stratified``: that share of
    every label.  ``exclusive``: as before, but one label is in the source only and
    another in the target only.  ``disjoint``: every label is on one side.
    ``shared``: ``n_shared`` labels are on both sides, the others on one.  ``given``:
    the labels in ``given`` are the source, all others the target.  Labels take
    their roles in the order of a hash; a null label is one more label.
    """
    if mode == "random":
        return _sided(draw(rows.withColumn("_all", F.lit(1)), ["_all"], share, 0, seed).drop("_all"), F.col("drawn"))
    if mode == "given":
        return _sided(rows.withColumn("drawn", F.coalesce(F.col(label).isin(list(given)), F.lit(False))), F.col("drawn"))
    drawn = draw(rows, [label], share, 1, seed)
    if mode == "stratified":
        return _sided(drawn, F.col("drawn"))
    # One row per label.
    labels = rows.select(F.col(label).alias("_label")).distinct()
    place = labels.select("_label", F.row_number().over(Window.orderBy(F.xxhash64("_label", F.lit(seed)), "_label")).alias("_place"))
    both = drawn.join(place, drawn[label].eqNullSafe(place["_label"])).drop("_label")
    p = F.col("_place")
    if mode == "exclusive":
        to_source = F.when(p == 1, True).when(p == 2, False).otherwise(F.col("drawn"))
    elif mode == "disjoint":
        to_source = p % 2 == 1
    elif mode == "shared":
        to_source = F.when(p <= n_shared, F.col("drawn")).otherwise(p % 2 == 1)
    else:
        raise ValueError(f"unknown mode {mode}")
    return _sided(both, to_source).drop("_place")


def _sided(rows: DataFrame, to_source: Column) -> DataFrame:
    return rows.withColumn("side", F.when(to_source, "source").otherwise("target")).drop("drawn")

