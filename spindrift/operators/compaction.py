"""Consolidating many small files into few sorted ones.

The rows are range-partitioned by their clustering keys: Spark samples the keys,
derives boundaries from the sample and gives each range to one output file.  The
number of ranges follows from a byte target.  The result is written beside the
target folder, its count and checksum are reconciled with those of the input, and
only then are the two folders swapped.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import scratch_path


@dataclass(frozen=True)
class CompactionReport:
    path: str
    rows: int
    files: int
    checksum: int


class ReconciliationError(RuntimeError):
    """The written rows are not the rows that were read; nothing was swapped."""


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row that is null-safe and knows the columns' order."""
    return F.xxhash64(*[F.coalesce(F.xxhash64(F.col(f"`{c}`")), F.lit(0)) for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])


def _sums(df: DataFrame) -> list[Column]:
    """Count and checksum; the checksum adds 32-bit parts, so it can't overflow below 2^31 rows a part."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.pmod(_row_hash(df), F.lit(1 << 31)).cast("decimal(38,0)")).alias("h")]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rename(spark: SparkSession, a: str, b: str) -> None:
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)
    if not src.getFileSystem(spark._jsc.hadoopConfiguration()).rename(src, dst):
        raise OSError(f"{a} could not be renamed to {b}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def recover(spark: SparkSession, path: str) -> None:
    """Finish or take back a swap that was broken off at ``path``.

    A folder set aside is put back if none is at ``path``, else it is deleted, as are
    rows written beside that never took its place.  No other compaction may be at
    work there.
    """
    base = path.rstrip("/")
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(p.getParent()):
        return
    beside = sorted((s.getModificationTime(), s.getPath().toString()) for s in files.listStatus(p.getParent()) if s.isDirectory())
    mine = [f for _, f in beside if f.rsplit("/", 1)[1].startswith(p.getName() + ".")]
    for old in reversed([f for f in mine if f.rsplit("/", 1)[1].startswith(p.getName() + ".old-")]):
        if _exists(spark, base):
            _delete(spark, old)
        else:
            _rename(spark, old, base)
    for staging in mine:
        if staging.rsplit("/", 1)[1].startswith(p.getName() + ".staging-"):
            _delete(spark, staging)


def compact(df: DataFrame, path: str, keys: list[str], target_bytes: int = 256 << 20, total_bytes: int | None = None) -> CompactionReport:
    """Write ``df`` to the folder ``path`` as few files sorted by ``keys``, none lost and none twice.

    ``target_bytes`` is the wanted size of a file, ``total_bytes`` the size of all rows
    as stored (``stored_bytes`` of the folder they come from); without it the rows
    are written once to the shared folder to learn it.  The ranges are cut by the keys and then
    by a hash of the whole row, so one key holding a third of all rows is spread
    over several files; only rows that are equal in every column stay together.

    Nulls sort first and are kept; an empty ``df`` gives one empty file; repeated
    rows are all kept (deduplicate before, if they are no records of their own);
    columns may have any name.  A folder already at ``path`` is replaced only
    after the new rows agree with ``df`` in count and checksum, else
    ``ReconciliationError`` is raised and the folder stays as it was.  A swap that
    broke off earlier is taken back first (``recover``).
    ``df`` is read three times (sums, boundaries, rows) and must give the same rows
    each time: cut its lineage before, if it is costly.
    """
    spark = df.sparkSession
    recover(spark, path)
    if total_bytes is None:
        held = scratch_path(spark, "to_compact")
        df.write.parquet(held)
        df, total_bytes = spark.read.schema(df.schema).parquet(held), stored_bytes(spark, held)
    want = df.agg(*_sums(df)).first()
    files = max(1, math.ceil(total_bytes / target_bytes))
    tie = "_tie_" + uuid.uuid4().hex[:8]
    order = [*[F.col(f"`{k}`") for k in keys], F.col(tie)]
    out = df.withColumn(tie, _row_hash(df)).repartitionByRange(files, *order).sortWithinPartitions(*order).drop(tie)
    mark = uuid.uuid4().hex[:8]
    base = path.rstrip("/")
    staging, old = f"{base}.staging-{mark}", f"{base}.old-{mark}"
    out.write.parquet(staging)
    got = spark.read.schema(out.schema).parquet(staging)
    have = got.agg(*_sums(got)).first()
    if (want["n"], want["h"] or 0) != (have["n"], have["h"] or 0):
        _delete(spark, staging)
        raise ReconciliationError(f"read {want['n']} rows (checksum {want['h']}), wrote {have['n']} (checksum {have['h']})")
    if _exists(spark, base):
        _rename(spark, base, old)
    _rename(spark, staging, base)
    if _exists(spark, old):
        _delete(spark, old)
    return CompactionReport(base, have["n"], files, int(have["h"] or 0))
