"""Incremental work: what is left to do, a streamed failure log, drift of stored plans, windows over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def remaining(todo: DataFrame, *done: DataFrame, keys: list[str]) -> DataFrame:
    """ST1, J16: rows of todo whose key isn't in all of done (a record counts as finished only if every part is there)."""
    finished = reduce(lambda a, b: a.join(b, keys, "left_semi"), [d.select(*keys).distinct() for d in done])
    return todo.join(finished, keys, "left_anti")


def stream_log(spark: SparkSession, path: str, schema: str, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """ST2: a folder of CSV shards as a stream, each key once within `late` of its event time.

    The time is a column, or else when a row's shard was written. Keys older than the watermark leave the state, so it holds
    those of about `late` and not all there ever were. A key that comes again after that comes through again: keep_log,
    the sink, has it once all the same.
    """
    rows = spark.readStream.schema(schema).option("header", True).csv(path)
    names = rows.columns
    timed = rows.withColumn("_time", F.col(event_time) if event_time else F.col("_metadata.file_modification_time"))
    return timed.withWatermark("_time", late).dropDuplicatesWithinWatermark(keys).select(*names)


def keep_log(stream: DataFrame, path: str, keys: list[str], checkpoint: str, writer: str = "log") -> StreamingQuery:
    """ST2: works a stream of failures off into a versioned table, each key once for good: its first row stays.

    A batch that is run again after a crash is known by its number and merged once; other writers of the table
    lose nothing (see versions.commit). Ends when all there is has been read; to go on, call again with the same checkpoint.
    """

    def merge(batch: DataFrame, number: int) -> None:
        def added(old: DataFrame | None) -> DataFrame:
            new = batch.dropDuplicates(keys)
            return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))

        if not batch.isEmpty():
            versions.commit(batch.sparkSession, path, added, writer=writer, batch=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift(stored: DataFrame, planned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """ST3: stored against recomputed plans. What is stored wins; status is same, changed, unverified or new."""
    s, p = stored.alias("s"), planned.alias("p")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{x}").eqNullSafe(F.col(f"p.{x}")) for x in columns])
    status = F.when(F.col(f"s.{key}").isNull(), "new").when(F.col(f"p.{key}").isNull(), "unverified").when(same, "same").otherwise("changed")
    joined = s.join(p, F.col(f"s.{key}") == F.col(f"p.{key}"), "full_outer")
    pick = [F.when(F.col(f"s.{key}").isNotNull(), F.col(f"s.{x}")).otherwise(F.col(f"p.{x}")).alias(x) for x in columns]
    return joined.select(F.coalesce(f"s.{key}", f"p.{key}").alias(key), *pick, status.alias("status"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; the same plan for a table and, with its watermark, for a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
