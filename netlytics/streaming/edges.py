"""Edges that arrive as a stream: counts in event-time windows, and upserts into a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_weights(stream: DataFrame, *, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(source, target, start, weight): edges counted in tumbling windows; what is later than the watermark is left out."""
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "source", "target").agg(F.count("*").alias("weight"))
    return counted.select("source", "target", F.col("w.start").alias("start"), "weight")


def upsert_edges(stream: DataFrame, path: str, checkpoint: str):
    """A query that keeps (source, target, weight, batch) rows: each micro-batch appends its own sums under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stored_edges(spark, path: str) -> DataFrame:
    """The sums of all batches."""
    return spark.read.parquet(path).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def transitions(events: DataFrame, *, user: str = "user_id", kind: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(source, target, weight): consecutive kinds of events of each user."""
    nexts = events.select(F.col(kind).alias("source"), F.lead(kind).over(Window.partitionBy(user).orderBy(*order)).alias("target"))
    return nexts.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
