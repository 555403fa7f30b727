"""Delimited files: result tables, wide matrices with their id and label files.

Files are read and written by all tasks at once; a wide matrix becomes one row per
place, (line, place, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def write_results(df: DataFrame, path: str, keys: Sequence[str] = (), decimals: int | None = None) -> None:
    """Comma-separated files with a header, one folder per value of the keys.

    Rows are brought together by their keys, and a key that holds too many is split
    over several files.  ``decimals`` fixes the digits of all floating-point columns;
    without it they are written in full.
    """
    if decimals is not None:
        shown = {f.name: F.format_string(f"%.{decimals}f", f.name) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), v) for c, v in shown.items()})
    if keys:
        df = df.hint("rebalance", *keys)
    writer = df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """All files below a path or pattern as one table; a header that differs from the schema is an error.

    Without a header the schema names the columns.  Folders named key=value give columns.
    """
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST")
    return reader.option("enforceSchema", not header).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of all files below a path, numbered from 0 by file name and place.

    Lines are never brought together: a task reads the lines of a block in order, so
    only the blocks' first numbers and sizes are added up.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value")
    blocks = raw.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per block of a file.
    before = F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(starts, ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("line"), "value")


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(line, place, value) of a matrix in text without a header; what is no number becomes null."""
    cells = numbered_lines(spark, path).where(F.trim("value") != "").select("line", F.posexplode(F.split("value", sep)).alias("place", "text"))
    return cells.select("line", "place", F.expr("try_cast(trim(text) as double)").alias("value"))


def write_lines(df: DataFrame, path: str, order: str, value: Column) -> None:
    """One line of text per row, in the order of a unique column over all files."""
    df.orderBy(order).select(F.coalesce(value, F.lit("")).alias("value")).write.text(path)


def write_matrix(df: DataFrame, path: str, order: str, features: str = "features", sep: str = "\t") -> None:
    """A row's features as one line; nulls become empty fields."""
    write_lines(df, path, order, F.concat_ws(sep, F.transform(features, lambda x: F.coalesce(x.cast("string"), F.lit("")))))


def table_line(cells: Sequence[Column], bold: Sequence[Column]) -> Column:
    """A line of a LaTeX table; cells whose condition holds are bold, nulls are dashes."""
    shown = [F.when(c.isNull(), "--").when(b, F.concat(F.lit("\\textbf{"), c, F.lit("}"))).otherwise(c) for c, b in zip(cells, bold, strict=True)]
    return F.concat(F.concat_ws(" & ", *shown), F.lit(" \\\\"))
