"""Event time of messages: the watermark on their time attribute, windows in append mode, keyed dedup over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stub_sentiment

#: The attribute that carries a message's event time.
TIME_ATTRIBUTE = "created_utc"


def read_messages(spark: SparkSession, inbox: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of (data, attributes, arrived) from a folder of JSON messages with data as base64."""
    reader = spark.readStream.schema("data string, attributes map<string,string>")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.json(inbox).select(F.unbase64("data").alias("data"), "attributes", F.col("_metadata.file_modification_time").alias("arrived"))


def timed(messages: DataFrame) -> DataFrame:
    """Add event_time: the time attribute; where it is missing, empty or no time, the message's arrival."""
    own = F.try_to_timestamp(F.nullif(F.col("attributes")[TIME_ATTRIBUTE], F.lit("")))
    return messages.withColumn("event_time", F.coalesce(own, F.col("arrived")))


def message_key(messages: DataFrame) -> DataFrame:
    """Add message_key: the record's id; messages without one are told apart by their bytes and attributes."""
    body = F.try_validate_utf8(F.col("data").cast("string"))
    own = F.nullif(F.get_json_object(body, "$.id"), F.lit(""))
    bytes_ = F.sha2(F.concat_ws("|", F.hex("data"), F.to_json(F.array_sort(F.map_entries("attributes")))), 256)
    return messages.withColumn("message_key", F.coalesce(F.concat(F.lit("id:"), own), F.concat(F.lit("bytes:"), bytes_)))


def drop_repeats(messages: DataFrame, within: str) -> DataFrame:
    """The first message of each key, also over micro-batches and restarts.

    A key is kept in state until the watermark passes its first event time by ``within``; a repeat beyond that comes
    through and is left to the merge by id.
    """
    keyed = message_key(messages if "event_time" in messages.columns else timed(messages))
    return keyed.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["message_key"]).drop("message_key")


def window_counts(rows: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Records by tumbling window of event_time, source and label; a window closes when the watermark passes its end."""
    day = F.window("event_time", width)
    counts = rows.withWatermark("event_time", late).groupBy(day, "source", "sentiment_label").agg(F.count(F.lit(1)).alias("records"))
    return counts.select(F.col("window.start").alias("window_start"), "source", "sentiment_label", "records")


def labelled(messages: DataFrame) -> DataFrame:
    """(event_time, source, sentiment_label) of the messages that carry a record."""
    body = F.try_validate_utf8(F.col("data").cast("string"))
    text, source = F.get_json_object(body, "$.text"), F.get_json_object(body, "$.source")
    return timed(messages).where(F.nullif(F.get_json_object(body, "$.id"), F.lit("")).isNotNull()).select("event_time", source.alias("source"), stub_sentiment(text)["label"].alias("sentiment_label"))


def run_windows(spark: SparkSession, inbox: str, out: str, checkpoint: str, late: str = "1 day", width: str = "1 day", files_per_batch: int | None = None) -> int:
    """Drain the inbox into closed windows, each written once; the number of late groups that were dropped.

    A record is late when its window had closed before its micro-batch began; records of one window, source and label
    that are late in the same micro-batch and task count as one group.  A restart goes on with the open windows.
    """
    counts = window_counts(labelled(read_messages(spark, inbox, files_per_batch)), late, width)
    query = counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    finally:
        query.stop()
