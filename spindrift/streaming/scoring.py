"""Structured Streaming: event counts by window, and scoring of arriving observations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.linalg import project
from spindrift.plans.matrix import _OBS, DIM, scaled_rows
from spindrift.session import scratch_path


def score_stream(stream: DataFrame, basis: np.ndarray, path: str, checkpoint: str):
    """Start a query that appends each batch's coordinates in ``basis`` to the table at ``path``.

    ``stream`` has row_id and features.  A batch is written to a folder of its own
    number, so one that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        project(batch, basis).select("row_id", "projected").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): counts and summed values per window; later rows than ``late`` are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque[t]")


def _final_state(counts: DataFrame, name: str) -> DataFrame:
    """The whole state of a small aggregate at the end of its stream: under a watermark the last windows would stay open."""
    spark = counts.sparkSession
    out = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream_checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/state")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream to its end and counted per day and type."""
    counts = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _final_state(counts, "stream_events").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows of an hour by the time of the event."""
    timed = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _final_state(windowed_counts(timed), "stream_hours")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells read as a stream to its end, each placed on three contrasts of neighbouring features as it arrives; of each cell one row."""
    kinds = spark.read.parquet(f"{sf_dir}/gene_data_set.parquet").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/gene_data_set.parque[t]")
    basis = np.zeros((DIM, 3))
    for c in range(3):
        basis[2 * c : 2 * c + 2, c] = [math.sqrt(0.5), -math.sqrt(0.5)]
    path = scratch_path(spark, "stream_scores")
    score_stream(scaled_rows(stream).select("row_id", "features"), basis, path, scratch_path(spark, "stream_checkpoint")).awaitTermination()
    once = spark.read.schema("row_id long, projected array<double>, batch int").parquet(path).groupBy("row_id").agg(F.min("projected").alias("p"))
    return once.select("row_id", *[F.round(F.col("p")[c], 8).alias(f"p{c}") for c in range(3)])


QUERIES = {"stream_events": stream_events, "stream_hours": stream_hours, "stream_scores": stream_scores}

SQL = {
    "stream_scores": _OBS + "select row_id, " + ", ".join(f"round((f[{2 * c + 1}] - f[{2 * c + 2}]) * sqrt(0.5), 8) as p{c}" for c in range(3)) + " from obs",
    "stream_hours": "select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_events": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
