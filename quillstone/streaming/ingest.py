"""Structured Streaming around the index: incremental ingest and windowed rates of a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import inverted
from ..operators.index import points
from ..sources.stored import stored


def ingest(chunks: DataFrame, target: str, checkpoint: str, provider: str = "local") -> StreamingQuery:
    """Points of newly arrived chunks, each micro-batch in a folder of its own under target.

    A batch that is run again overwrites its own folder, so nothing is doubled; latest() reads the last version of a point.
    """

    def put(batch: DataFrame, number: int) -> None:
        points(batch, provider).withColumn("ordinal", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_index(chunks: DataFrame, path: str, checkpoint: str, locality: tuple[str, ...] = ()) -> StreamingQuery:
    """An inverted index that is kept up with arriving chunks (point_id, text, ordinal, locality columns): a micro-batch is a batch of it.

    Chunks that come again replace their older versions; of several in one micro-batch the last by ordinal stays. A
    micro-batch that runs again overwrites what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("point_id").agg(F.max_by(F.struct(*batch.columns), "ordinal").alias("x")).select("x.*")
        inverted.add(stored(last), path, number, locality)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The index as of now: of each point id the row of the last batch."""
    rows = spark.read.parquet(target).drop("batch")
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*rows.columns), "ordinal").alias("x")).select("x.*").drop("ordinal")


def rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")
