"""Streams over events: windows, sessions, repeats, and a stateful limiter.

Each function builds a streaming DataFrame from one of events (event time in a
TIMESTAMP column ``at``); :func:`run_to_table` drains what has arrived into a
Parquet table with ``availableNow``, exactly once through the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import new_path

#: How far back event time may run, and the limiter's window.
LATE = "60 days"


def event_stream(spark: SparkSession, folder: str, late: str = LATE, name: str = "events") -> DataFrame:
    """The events as a stream.  Event time must be TIMESTAMP for a watermark, so
    zone-free stamps are read as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{name}.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return events.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("at", size, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "n", "most")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once while the watermark holds it."""
    return events.dropDuplicatesWithinWatermark(keys)


def limiter(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, seen, admitted): a sliding-window limiter with state per user.

    An event is admitted if fewer than ``limit`` were admitted in the last
    ``seconds``; state is the admitted stamps inside the window, at most
    ``limit`` of them."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stamps = list(state.get[0]) if state.exists else []
        seen = admitted = 0
        for part in parts:
            for at in sorted(part["micros"]):
                seen += 1
                stamps = [s for s in stamps if s > at - seconds * 1_000_000]
                if len(stamps) < limit:
                    stamps.append(at)
                    admitted += 1
        state.update((stamps,))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "admitted": [admitted]})

    keyed = events.select("user_id", F.unix_micros("at").alias("micros"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, seen long, admitted long", "stamps array<long>", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain the stream.  ``complete`` keeps the last result of an aggregate,
    ``append`` what each batch adds."""
    spark = stream.sparkSession
    path, marks = new_path(spark, name), new_path(spark, f"{name}-marks")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
