"""Continuous usage roll-up over a growing folder of log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.scalars import event_time
from lodestone.plans.usage import rollup_of
from lodestone.sources.events import parse_events
from lodestone.sources.paths import path_exists

LATENESS = "10 minutes"


def stream_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Log lines as they arrive, with the event time in ``at``."""
    lines = spark.readStream.options(**options).text(path)
    return parse_events(lines).withColumn("at", event_time(F.col("ts")))


def rolled_up(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The hourly roll-up on a stream; rows later than ``lateness`` are left out."""
    return rollup_of(events.withWatermark("at", lateness))


def start_rollup(
    spark: SparkSession,
    source: str,
    state: str,
    sink: Callable[[DataFrame, int], None],
    mode: str = "update",
    lateness: str = LATENESS,
    **options: str,
) -> StreamingQuery:
    """Process what has arrived since the last start and stop.

    ``update`` hands every changed hour to ``sink``, for a table that is merged by hour
    and method; ``append`` hands over each hour once, after the watermark has passed it.
    """
    return (
        rolled_up(stream_events(spark, source, **options), lateness)
        .writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def merge_rollup(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The live table after one update batch: changed hours replace their old rows."""
    if current is None:
        return batch
    kept = current.join(batch.select("hour_start", "metodo"), ["hour_start", "metodo"], "left_anti")
    return kept.unionByName(batch)


def merge_days(batch: DataFrame, path: str) -> None:
    """Merge one update batch into a live table that is stored by day; other days are neither read nor written.

    A batch carries whole rows, not increments, so one that is repeated changes nothing.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("day", F.to_date("hour_start")).persist()  # a row per changed hour and method
    try:
        before = None
        if path_exists(spark, f"{path}/day=*"):
            days = batch.select("day").distinct()
            before = spark.read.schema(batch.schema).parquet(path).join(days, "day", "left_semi").select(*batch.columns)
        merged = merge_rollup(before, batch).repartition("day")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    finally:
        batch.unpersist()
