"""Streaming forms of the log analytics: windows with watermarks, duplicates, and the login throttle as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from marlstone.session import scratch

DELAYS = tuple(map(float, (0, 0, 1, 2, 5, 10, 30, 60)))
WINDOW_S = 300


def read_events(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files of a folder; ts becomes a timestamp with a zone, as watermarks need one."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by type in windows of one width."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Each user's sessions, which a gap ends."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def delay(recent: int) -> float:
    """Seconds to wait before the next try after so many recent failures."""
    return DELAYS[min(recent, len(DELAYS) - 1)]


def throttle_batch(failures: DataFrame) -> DataFrame:
    """failures (address, id, t in seconds) with the wait that each one meets: by how many of the address fell in the 300 seconds before it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("address").orderBy("t").rangeBetween(-WINDOW_S, 0)
    same = W.partitionBy("address", "t")
    before = F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(same)
    at = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(before, F.lit(len(DELAYS) - 1)).cast("int") + 1)
    return failures.withColumn("delay_s", at)


def throttle_stream(failures: DataFrame) -> DataFrame:
    """The same on a stream, with the recent failures of an address as its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out = []
        for i, t in zip(rows["id"], rows["t"], strict=True):
            recent = [x for x in recent if x >= t - WINDOW_S]
            out.append((key[0], i, t, delay(sum(x < t for x in recent))))
            recent.append(t)
        state.update((recent,))
        yield pd.DataFrame(out, columns=["address", "id", "t", "delay_s"])

    return failures.groupBy("address").applyInPandasWithState(step, "address long, id long, t long, delay_s double", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, streamed into a written table, and that table."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    if mode == "append":
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
