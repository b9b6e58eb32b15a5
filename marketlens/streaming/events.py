"""Event streams: exactly-once ids, windows, sessions and rate limits that only count accepted events."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def source(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """Parquet files as a stream, with the schema of those that are there; a single file is named by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    In append mode each batch adds files exactly once; in complete mode a batch replaces the table of the one before.
    """
    spark = stream.sparkSession
    out, state = folder(spark, "stream"), folder(spark, "state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def unique_events(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each id once, with state that the watermark clears."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark([key]).drop("at")


def windows(events: DataFrame, size: str, *keys: str, ts: str = "ts") -> DataFrame:
    """Counts and sums in tumbling windows."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp"))
    return rows.groupBy(F.window("at", size), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.unix_seconds("window.start").alias("start"), *keys, "n", "value")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    """Stretches of a key's events without a pause of ``gap`` or more (after which it counts as gone)."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp"))
    return rows.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n")).select(F.unix_micros("session_window.start").alias("start"), key, "n")


def rate_limited(events: DataFrame, key: str, limit: int, seconds: float, id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """Whether each event is accepted: at most ``limit`` accepted ones of a key in any stretch of ``seconds``.

    Refused events don't count, so this is a fold with state: the moments of the last accepted ones, ``limit`` at most.
    """
    window = int(seconds * 1_000_000)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(["at", "id"])
        accepted = []
        for at in rows["at"].tolist():
            recent = [x for x in recent if x > at - window]
            ok = len(recent) < limit
            if ok:
                recent.append(at)
            accepted.append(ok)
        state.update((recent,))
        yield pd.DataFrame({"id": rows["id"], "key": k[0], "accepted": accepted})

    rows = events.select(F.col(id_col).alias("id"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(fold, "id long, key string, accepted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def slots(events: DataFrame, hours: float, ts: str = "ts") -> DataFrame:
    """First and last moment of each stretch of so many hours, as a streaming aggregation."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(F.floor(at / int(hours * 3_600_000_000)).alias("slot")).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def gaps(slots: DataFrame, hours: float) -> DataFrame:
    """Pauses of more than some hours, from what ``slots`` of these hours has so far.

    A longer pause can't begin and end in one slot, so comparing slots (a row each) loses none.
    """
    before = F.lag("last").over(Window.orderBy("slot"))
    return slots.withColumn("gap_start", before).where(F.col("first") - F.col("gap_start") > int(hours * 3_600_000_000)).select("gap_start", F.col("first").alias("gap_end"))
