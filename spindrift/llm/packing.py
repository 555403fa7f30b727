"""Filling containers of one fixed capacity under a target mixture of sources.

Every source is a queue.  The stream of containers is divided into windows; a
window owes each source a quantum of tokens in proportion to its target share.
A source serves items while its served tokens stay below what it has been owed so
far, so an item that overshoots is a deficit that the next window takes off: the
window of an item is the number of whole quanta before its first token.  The
tokens before an item are a prefix sum over the source's queue, taken over blocks
first, so the deficits carry across windows and partitions without any task
seeing a whole queue.

Within a window, whose size is bounded by its tokens, the items are packed best
fit decreasing.  The containers that stay open at the end of a window are packed
again with those of other windows.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import cut

#: Rows of a queue that one task puts in order.
BLOCK_ROWS = 50_000

#: Containers of one window.
WINDOW_CONTAINERS = 16

#: Windows whose open containers are packed again together.
GROUP_WINDOWS = 64

#: A container filled at least so far is closed at the end of its window.
CLOSED_AT = 0.995

_PACKED = "container_no long, item_id long, source string, part int, size int, start int, window long"


def split_large(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, source, part, size): an item beyond the capacity becomes full parts and a rest.

    Items of size 0 or null hold nothing and are left out.
    """
    last = F.ceil(F.col("size") / F.lit(float(capacity))).cast("int") - 1
    parts = items.where("size > 0").select("item_id", "source", "size", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select("item_id", "source", "part", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("int").alias("size"))


def queue_offsets(items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``items`` with ``before``: the tokens ahead of each item in its source's queue.

    The order of a queue is a hash of the item, so that any stretch of it mixes the
    source's items.  Blocks of a queue are stretches of that hash; their number
    follows from the number of rows.
    """
    blocks = max(1, math.ceil(items.count() / block_rows))
    place = F.xxhash64("item_id", "part")
    width = (1 << 64) / blocks
    placed = items.withColumn("_place", place).withColumn("_block", F.least(F.floor((F.col("_place").cast("double") + float(1 << 63)) / F.lit(width)), F.lit(blocks - 1)).cast("int"))
    sums = placed.groupBy("source", "_block").agg(F.sum("size").cast("long").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_block").orderBy("_place", "item_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(sums, ["source", "_block"]).withColumn("before", F.col("_ahead") + F.col("_inner")).drop("_place", "_block", "_ahead", "_inner")


def window_of(before: Column, share: Column, window_tokens: int) -> Column:
    """The window that owes the token behind ``before`` to its source."""
    return F.floor(before / F.greatest(F.lit(1.0), share * F.lit(float(window_tokens)))).cast("long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, best fit decreasing; O(n log n)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []
    where, opened = [0] * len(sizes), 0
    for i in order:
        k = bisect.bisect_left(room, (sizes[i], -1))
        if k == len(room):
            left, c = capacity, opened
            opened += 1
        else:
            left, c = room.pop(k)
        where[i] = c
        if left - sizes[i] > 0:
            bisect.insort(room, (left - sizes[i], c))
    return where


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["item_id", "part"], kind="stable").reset_index(drop=True)
    pdf["container_no"] = pd.Series(best_fit(pdf["size"].tolist(), capacity), dtype="int64")
    pdf = pdf.sort_values(["container_no", "size", "item_id", "part"], ascending=[True, False, True, True], kind="stable")
    pdf["start"] = pdf.groupby("container_no")["size"].cumsum() - pdf["size"]
    return pdf[["container_no", "item_id", "source", "part", "size", "start", "window"]].astype({"part": "int32", "size": "int32", "start": "int32", "window": "int64"})


def target_shares(items: DataFrame, power: float) -> DataFrame:
    """(source, share): the sources' shares of all tokens raised to a power and scaled to one; below 1 it lifts small sources."""
    tokens = items.where("size > 0").groupBy("source").agg(F.sum("size").alias("n"))
    lifted = F.pow(F.col("n").cast("double"), F.lit(power))
    return tokens.select("source", (lifted / F.sum(lifted).over(Window.partitionBy())).alias("share"))


def pack(
    items: DataFrame,
    capacity: int,
    shares: DataFrame | None = None,
    window_containers: int = WINDOW_CONTAINERS,
) -> DataFrame:
    """Put items (item_id, source, size) into containers: (container_id, item_id, source, part, size, start, window).

    ``shares`` (source, share) are the target token proportions of the sources,
    adding up to one; without it they are the sources' shares of all tokens, so that
    all queues end at the same window.  In every window a source serves its share of
    the window's tokens, to within one item; a source with a larger target than it
    has tokens runs dry early, the others go on at the same rate.  A source that
    ``shares`` doesn't name gets its own share of the tokens.  A null source is a
    source.

    No item is split unless it is larger than ``capacity``; the full parts of such
    an item count in their source's queue and fill containers alone.  Items of size
    0 or null are left out.  An empty table gives no containers.  ``item_id`` must be
    unique.  Containers closed in a window keep its number; the items of the rest are
    packed again for a group of windows, so only there can containers of
    neighbouring windows mix.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    window_tokens = capacity * window_containers
    named = F.coalesce(F.col("source"), F.lit("\x00null"))
    parts = cut(split_large(items.select("item_id", named.alias("source"), "size"), capacity), "items")
    totals = parts.groupBy("source").agg(F.sum("size").alias("_tokens"))
    totals = totals.withColumn("_share", F.col("_tokens") / F.sum("_tokens").over(Window.partitionBy()))
    if shares is not None:
        totals = totals.join(shares.select(named.alias("source"), F.col("share").alias("_target")), "source", "left").withColumn("_share", F.coalesce("_target", "_share"))
    queued = queue_offsets(parts).join(totals.select("source", "_share"), "source")
    windows = queued.select("item_id", "source", "part", "size", window_of(F.col("before"), F.col("_share"), window_tokens).alias("window"))

    def in_window(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _pack_group(pdf, capacity)
        return out.assign(closed=out.groupby("container_no")["size"].transform("sum") >= CLOSED_AT * capacity)

    first = cut(windows.groupBy("window").applyInPandas(in_window, _PACKED + ", closed boolean"), "windows")
    # The open containers' items, a small part, are packed again for so many windows at once.
    group = F.floor(F.col("window") / GROUP_WINDOWS).cast("long")
    second = first.where("not closed").drop("closed").groupBy(group.alias("group")).applyInPandas(lambda pdf: _pack_group(pdf, capacity), _PACKED)
    name = lambda prefix, *c: F.concat_ws("-", F.lit(prefix), *c)
    rest = ["item_id", F.nullif("source", F.lit("\x00null")).alias("source"), "part", "size", "start", "window"]
    return (
        first.where("closed")
        .select(name("w", "window", "container_no").alias("container_id"), *rest)
        .unionByName(second.select(name("r", group, "container_no").alias("container_id"), *rest))
    )


def mixture_report(packed: DataFrame, shares: DataFrame, capacity: int, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """(window, source, n_tokens, target_tokens, largest, dry): what each source serves in each window.

    Until a queue runs dry (its last window is ``dry``), ``n_tokens`` is within the
    ``largest`` item of that source of ``target_tokens``.
    """
    per = packed.groupBy("window", "source").agg(F.sum("size").alias("n_tokens"))
    whole = packed.groupBy("source").agg(F.max("size").alias("largest"), F.max("window").alias("_last"))
    got = per.join(whole, per["source"].eqNullSafe(whole["source"])).drop(whole["source"])
    got = got.join(shares.withColumnRenamed("source", "_s"), got["source"].eqNullSafe(F.col("_s")))
    return got.select("window", "source", "n_tokens", (F.col("share") * F.lit(float(capacity * window_containers))).alias("target_tokens"), "largest", (F.col("window") == F.col("_last")).alias("dry"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity left unused."""
    return packed.agg(F.countDistinct("container_id").alias("n_containers"), F.sum("size").alias("n_tokens")).select(
        "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.lit(float(capacity)))).alias("unused_share")
    )
