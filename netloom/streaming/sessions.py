"""A stream of events as networks: each session of a user is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", most: int | None = None) -> DataFrame:
    """(user_id, begin, nodes): a stream's sessions with their events in order; events later than the
    watermark are left out, as the engine does."""
    each = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    nodes = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value")))
    return each.agg(nodes.alias("nodes")).select("user_id", F.col("w.start").alias("begin"), "nodes")


def session_networks(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sessions, keyed by user and begin."""
    node = found.select("user_id", "begin", F.explode("nodes").alias("n")).select("user_id", "begin", F.col("n.event_id").alias("node_id"), "n.event_type", "n.value")
    ids = F.transform("nodes", lambda n: n["event_id"])
    pairs = F.arrays_zip(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))).alias("source"), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))).alias("target"))
    edges = found.select("user_id", "begin", F.explode(pairs).alias("e")).select("user_id", "begin", "e.source", "e.target")
    return node, edges


def stream(spark: SparkSession, path: str, schema, each_batch: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "30 minutes", late: str = "1 hour", pattern: str = "*") -> StreamingQuery:
    """Run a batch operator on every micro-batch of finished sessions."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    writer = sessions(events, gap, late).writeStream.outputMode("append").foreachBatch(each_batch)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
