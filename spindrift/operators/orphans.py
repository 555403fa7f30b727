"""References to records that do not exist (yet, or any more).

Keys are coded as (stem, integer).  The distinct parent keys are compressed into
runs of consecutive integers per stem; every distinct reference is matched as of
to the last run that starts at or before it, and lies beyond that run's end if no
parent has it.  References that lie inside a run are then held against the times
at which their key was there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one stem are matched in blocks of 2^16 integers, so that a stem that
#: holds most keys is spread over many tasks.  Runs are cut at block ends.
BLOCK_BITS = 16

#: A string of at most 31 bases, with an optional number behind it, is read in base 4.
_BASES = "^([ACGTacgt]{8,31})(-[0-9]+)?$"


@dataclass(frozen=True)
class Reference:
    """``child_field`` of the child rows refers to ``parent_field`` of the parent rows."""

    name: str
    child_field: str
    parent_field: str


def normal_key(key: Column) -> Column:
    """Keys are compared without case and outer white space; a blank one is null."""
    text = F.lower(F.regexp_replace(key.cast("string"), r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def key_code(key: Column) -> Column:
    """(stem, block, num) of a normalised key; different keys have different codes.

    Barcodes of bases become a base-4 integer with their length and suffix as the
    stem, other keys their trailing integer (without leading zeros) with the text
    before it as the stem, keys without one the integer -1.
    """
    bases = F.regexp_extract(key, _BASES, 1)
    is_bases = bases != ""
    tail = F.regexp_extract(key, "(?:^|.*?)(0|[1-9][0-9]{0,14})$", 1)
    num = (
        F.when(is_bases, F.conv(F.translate(bases, "acgtACGT", "01230123"), 4, 10).cast("long"))
        .when(tail != "", tail.cast("long"))
        .otherwise(F.lit(-1).cast("long"))
    )
    stem = F.when(
        is_bases, F.concat(F.lit("~"), F.length(bases).cast("string"), F.regexp_extract(key, _BASES, 2))
    ).otherwise(F.concat(F.lit("="), F.substring(key, F.lit(1), F.length(key) - F.length(tail))))
    return F.struct(stem.alias("stem"), F.shiftright(num, BLOCK_BITS).alias("block"), num.alias("num"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Runs (stem, block, run_start, run_end) of consecutive integers from distinct (stem, block, num)."""
    w = Window.partitionBy("stem", "block").orderBy("num")
    island = keys.withColumn("_island", F.col("num") - F.row_number().over(w))
    return island.groupBy("stem", "block", "_island").agg(F.min("num").alias("run_start"), F.max("num").alias("run_end")).drop("_island")


def match_runs(references: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct reference codes with ``known``: whether the run at or before them reaches them."""
    both = references.select("stem", "block", "num", F.lit(None).cast("long").alias("run_end"), F.lit(1).alias("_is_ref")).unionByName(
        runs.select("stem", "block", F.col("run_start").alias("num"), "run_end", F.lit(0).alias("_is_ref"))
    )
    w = Window.partitionBy("stem", "block").orderBy("num", "_is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("_end", F.last("run_end", ignorenulls=True).over(w)).where("_is_ref = 1")
    return matched.select("stem", "block", "num", F.coalesce(F.col("num") <= F.col("_end"), F.lit(False)).alias("known"))


def key_times(parents: DataFrame) -> DataFrame:
    """The times at which each key was there, as few disjoint intervals.

    From (stem, num, from_ts, to_ts), to_ts null for an open end, come
    (stem, num, first_ts, spans): spans are sorted and disjoint, so rows delivered
    again or overlapping add nothing.
    """
    spans = parents.groupBy("stem", "num", "from_ts").agg(
        F.when(F.count(F.when(F.col("to_ts").isNull(), 1)) > 0, F.lit(None)).otherwise(F.max("to_ts")).alias("to_ts"),
    )
    w = Window.partitionBy("stem", "num").orderBy("from_ts").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("stem", "num").orderBy("from_ts").rowsBetween(Window.unboundedPreceding, 0)
    open_before = F.coalesce(F.max(F.col("to_ts").isNull()).over(w), F.lit(False))
    starts = ~open_before & (F.max("to_ts").over(w).isNull() | (F.max("to_ts").over(w) < F.col("from_ts")))
    spans = spans.withColumn("_new", starts.cast("int")).withColumn("_span", F.sum("_new").over(w_all))
    merged = spans.groupBy("stem", "num", "_span").agg(
        F.min("from_ts").alias("from_ts"),
        F.when(F.max(F.col("to_ts").isNull()), F.lit(None)).otherwise(F.max("to_ts")).alias("to_ts"),
    )
    return merged.groupBy("stem", "num").agg(
        F.min("from_ts").alias("first_ts"), F.array_sort(F.collect_list(F.struct("from_ts", "to_ts"))).alias("spans")
    )


def _parent_rows(parent: DataFrame, ref: Reference, loaded: str, deleted: str) -> DataFrame:
    """(stem, block, num, from_ts, to_ts): the codes of the parent's keys under this reference, with their times."""
    ts = "timestamp_ntz"
    gone = F.col(deleted) if deleted in parent.columns else F.lit(None)
    rows = parent.select(
        normal_key(F.col(ref.parent_field)).alias("_key"),
        F.coalesce(F.col(loaded).cast(ts), F.lit("0001-01-01").cast(ts)).alias("from_ts"),
        gone.cast(ts).alias("to_ts"),
    )
    return _coded(rows.where("_key is not null"), ref, "from_ts", "to_ts")


def _coded(rows: DataFrame, ref: Reference, *keep: str) -> DataFrame:
    """Codes of ``_key``; the reference's name before the stem keeps references apart in one table."""
    code = rows.select(key_code(F.col("_key")).alias("_c"), *keep)
    stem = F.concat(F.lit(ref.name), F.col("_c.stem"))
    return code.select(stem.alias("stem"), F.col("_c.block").alias("block"), F.col("_c.num").alias("num"), *keep)


def find_orphans(
    children: list[tuple[str, DataFrame, str, list[tuple[Reference, DataFrame]]]],
    loaded: str = "loaded_at",
    deleted: str = "deleted_at",
) -> DataFrame:
    """(child, row_id, field, kind, loaded_at): one row for each child row and reference that isn't good.

    ``children`` are (name, rows, row id, [(reference, parent rows), ...]).  A
    reference made at the child's ``loaded`` is good if some parent row with the key
    was loaded at or before it and is not deleted by it.  Otherwise ``kind`` is
    ``missing`` (no parent row has the key), ``deleted`` (one was loaded by then) or
    ``late``.  Null and blank keys are no references; a child row delivered several
    times (the same row id) is reported once, for its earliest load; a parent
    without the ``deleted`` column has no deletions; a child row without a time
    counts as made at the end of time.  A parent row without ``loaded`` is taken to
    have been there always.  Empty tables give no rows, except that every reference
    to an empty parent is missing.

    All references go through one plan, told apart by their stems; a child table is
    read once for all its fields.  The distinct references are matched, not the
    rows: a key that a third of all rows name is one row there.  The rows then meet
    their key's short result in a join that Spark broadcasts if it measures it to be
    small, and otherwise splits where it is skewed.
    """
    ts = "timestamp_ntz"
    parents = reduce(DataFrame.unionByName, [_parent_rows(p, ref, loaded, deleted) for _, _, _, refs in children for ref, p in refs])
    tables = []
    for name, rows, row_id, refs in children:
        fields = F.array(*[F.struct(F.lit(ref.name).alias("ref"), F.lit(ref.child_field).alias("field"), normal_key(F.col(ref.child_field)).alias("key")) for ref, _ in refs])
        each = rows.select(F.lit(name).alias("child"), F.col(row_id).cast("long").alias("row_id"), F.coalesce(F.col(loaded).cast(ts), F.lit("9999-12-31").cast(ts)).alias("at"), F.explode(fields).alias("_f"))
        each = each.where("_f.key is not null").select("child", "row_id", "at", "_f.field", "_f.ref", key_code(F.col("_f.key")).alias("_c"))
        tables.append(each.select("child", "row_id", "at", "field", F.concat("ref", "_c.stem").alias("stem"), F.col("_c.block").alias("block"), F.col("_c.num").alias("num")))
    rows = reduce(DataFrame.unionByName, tables)

    runs = key_runs(parents.select("stem", "block", "num").distinct())
    known = match_runs(rows.select("stem", "block", "num").distinct(), runs)
    keys = known.join(key_times(parents), ["stem", "num"], "left").select("stem", "num", "known", "first_ts", "spans")

    found = rows.join(keys, ["stem", "num"])
    good = F.exists("spans", lambda s: (s["from_ts"] <= F.col("at")) & (s["to_ts"].isNull() | (s["to_ts"] > F.col("at"))))
    kind = F.when(~F.col("known"), "missing").when(good, None).when(F.col("first_ts") <= F.col("at"), "deleted").otherwise("late")
    found = found.select("child", "row_id", "field", kind.alias("kind"), "at").where("kind is not null")
    # Only orphans, a small part, are looked at for double delivery.
    return found.groupBy("child", "row_id", "field").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("loaded_at"))
