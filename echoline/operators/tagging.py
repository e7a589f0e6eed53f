"""Nearest lifecycle event, window filters, replay schedule and messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BACKGROUND, RAW_COLUMNS
from .durable import durable


def tag_nearest(records: DataFrame, calendar: DataFrame, days: float = 3.0, at: str = "created_utc") -> DataFrame:
    """Add event_tag: the calendar event nearest within ``days`` (inclusive), ties by date and id; else the background.

    The calendar is folded into one row (array of events), so the records are neither shuffled nor multiplied.
    The calendar is a hand-kept configuration of some dozen rows.
    """
    folded = calendar.agg(F.collect_list(F.struct(F.col("date_utc").cast("timestamp").alias("t"), "date_utc", "id")).alias("_events"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    near = F.transform("_events", lambda e: F.struct(F.abs(seconds(F.col(at)) - seconds(e["t"])).alias("d"), e["date_utc"].alias("date"), e["id"].alias("id")))
    near = F.array_min(F.filter(near, lambda e: e["d"] <= int(days * 86_400_000_000)))
    return records.crossJoin(F.broadcast(folded)).withColumn("event_tag", F.coalesce(near["id"], F.lit(BACKGROUND))).drop("_events")


def window_filter(df: DataFrame, start=None, end=None, at: str = "created_utc") -> DataFrame:
    """Half-open [start, end)."""
    df = df.where(F.col(at) >= F.lit(start).cast("timestamp")) if start is not None else df
    return df.where(F.col(at) < F.lit(end).cast("timestamp")) if end is not None else df


def replay(staging: DataFrame, event: str | None = None, start=None, end=None) -> DataFrame:
    """The rows to replay, in total order (created_utc, id); filters reach the scan."""
    chosen = staging.where(F.col("event_tag") == event) if event else staging
    return window_filter(chosen, start, end).select(*RAW_COLUMNS).orderBy("created_utc", "id")


def schedule(staging: DataFrame, speedup: float = 86_400.0, max_sleep: float = 5.0) -> DataFrame:
    """Sleep before each record and simulated microseconds since the start, in the order (created_utc, id).

    The records are range partitioned once; one pass over each sorted partition gives the gaps and their sum inside it.
    What a partition's first record and all its sums need from before is carried in from a table of one row a partition.
    """
    partition = "_partition long, _head boolean, id string, _t long, sleep_s double, _us long"

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = batch.column(1).to_numpy()
            if not len(at):
                continue
            gap = np.diff(at, prepend=at[0] if last is None else last) / 1e6
            sleep = np.where(gap > 0, np.minimum(gap / speedup, max_sleep), 0.0)
            passed = total + np.cumsum(np.floor(sleep * 1e6 + 0.5).astype(np.int64))
            head = np.zeros(len(at), bool)
            head[0], last, total = last is None, at[-1], int(passed[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(head), batch.column(0), batch.column(1), pa.array(sleep), pa.array(passed)], ["_partition", "_head", "id", "_t", "sleep_s", "_us"])

    rows = staging.select("id", F.unix_micros("created_utc").alias("_t")).repartitionByRange("_t", "id").sortWithinPartitions("_t", "id")
    passes = durable(rows.mapInArrow(gaps, partition))
    before = Window.orderBy("_partition")
    ends = passes.groupBy("_partition").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_us").alias("_sum"))
    gap = (F.col("_first") - F.lag("_last").over(before)) / 1e6
    ends = ends.withColumn("_sleep", F.when(gap > 0, F.least(gap / speedup, F.lit(max_sleep))).otherwise(0.0))
    ends = ends.withColumn("_extra", F.round(F.col("_sleep") * 1e6).cast("long"))
    ends = ends.select("_partition", "_sleep", (F.sum(F.col("_sum") + F.col("_extra")).over(before) - F.col("_sum")).alias("_offset"))
    return passes.join(F.broadcast(ends), "_partition").select(  # as many rows as there are partitions
        "id", F.timestamp_micros("_t").alias("created_utc"), F.when(F.col("_head"), F.col("_sleep")).otherwise(F.col("sleep_s")).alias("sleep_s"), (F.col("_offset") + F.col("_us")).alias("at_us")
    )


def messages(records: DataFrame, replayed_at: str) -> DataFrame:
    """struct<data, attributes> messages: the record as JSON with nulls, and four string attributes ('' for null)."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [iso(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in records.select(*RAW_COLUMNS).dtypes]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    text = lambda c: F.coalesce(c, F.lit(""))
    attributes = F.create_map(
        F.lit("source"), text(F.col("source")), F.lit("event_tag"), text(F.col("event_tag")),
        F.lit("created_utc"), text(iso(F.col("created_utc"))), F.lit("replayed_at"), F.lit(replayed_at),
    )
    return records.select(F.encode(body, "UTF-8").alias("data"), attributes.alias("attributes"))
