"""Incremental upserts and windowed counts over the event log, as batch and as stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import delete, shared_dir

ROW = ("event_type", "value")


def latest_versions(events: DataFrame) -> DataFrame:
    """The last event of each user with its version, the number of the user's events: user_id, event_type, value, version."""
    grouped = events.groupBy("user_id").agg(F.max_by(F.struct(*ROW), F.struct("ts", "event_id")).alias("r"), F.count(F.lit(1)).cast("int").alias("version"))
    return grouped.select("user_id", "r.event_type", "r.value", "version")


def _source(spark: SparkSession, root: str) -> DataFrame:
    schema = table(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{root}/events.parquet*")


def stream_latest(spark: SparkSession, root: str, merge_every: int = 16) -> DataFrame:
    """latest_versions kept up by foreachBatch: each micro-batch is reduced and stored as a part of the state.

    A batch costs its own users, not the state. Every ``merge_every`` parts
    of a level are merged into one of the next level and deleted, so a user is rewritten
    once a level. A part is named by its batch: one that runs again after a
    failure overwrites its own part only, so it counts once.
    """
    base = f"{shared_dir(spark)}/clausewright/stream-{uuid.uuid4().hex}"
    state = "user_id long, ts timestamp_ntz, event_id long, event_type string, value double, version long"
    parts: dict[str, int] = {}

    def reduced(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("ts", "event_id", *ROW), F.struct("ts", "event_id")).alias("r")
        return rows.groupBy("user_id").agg(best, F.sum("version").alias("version")).select("user_id", "r.*", "version")

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        name = f"{base}/0-{number}"
        reduced(batch.select("user_id", "ts", "event_id", *ROW, F.lit(1).cast("long").alias("version"))).write.mode("overwrite").parquet(name)
        parts[name] = 0
        level = 0
        while len(old := [p for p, at in parts.items() if at == level]) >= merge_every:
            level += 1
            name = f"{base}/{level}-{number}"
            reduced(session.read.schema(state).parquet(*old)).write.mode("overwrite").parquet(name)
            parts[name] = level
            for p in old:
                del parts[p]
                delete(session, p)

    run = _source(spark, root).writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(state).parquet(*parts) if parts else spark.createDataFrame([], state)
    return reduced(rows).select("user_id", *ROW, F.col("version").cast("int").alias("version"))


def stream_hourly(spark: SparkSession, root: str) -> DataFrame:
    """Events per hour and type by a tumbling window with a watermark.

    In update mode each batch gives the windows it changed and state behind
    the watermark is dropped. The sink keeps each batch's rows in a folder of
    its own; the newest row of a window counts.
    """
    base = f"{shared_dir(spark)}/clausewright/stream-{uuid.uuid4().hex}"
    hours = _source(spark, root).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours").groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = hours.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("start timestamp_ntz, event_type string, n long, total double, batch long").parquet(f"{base}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.n", "r.total")
