"""Watching a source tree with Structured Streaming: changes, bursts of them, and a rebuild after each burst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.changes import IGNORED, TreeChanges
from ..sources.store import qualified

#: Fixed value: a burst has ended when nothing changed for so long.
QUIET = "400 milliseconds"
#: Partitions of the state; its keys are trees.
STATE_PARTITIONS = 4


def watched(path: F.Column) -> F.Column:
    """Whether a changed path counts."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in IGNORED)))


def bursts(events: DataFrame, ts: str, key: str, gap: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, changes, first_change): bursts of events less than a gap apart. On a stream, set a watermark on ts first: a burst comes out once
    the watermark has passed its last event by the gap. `keep` names columns that are kept of every event, with its time as `at`, in the array `events`."""
    kept = [F.collect_list(F.struct(*keep, F.col(ts).alias("at"))).alias("events")] if keep else []
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("changes"), F.min(ts).alias("first_change"), *kept).drop("w")


def last_changes(events: DataFrame) -> DataFrame:
    """(path, change): of events (path, change, at) the last of each path."""
    return events.groupBy("path").agg(F.max_by("change", "at").alias("change")).where("change is not null")


def tree_changes(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The stream (tree, path, change, at) of a folder. Each trigger also gives a row without path, so that time goes on while nothing changes."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format(TreeChanges.name()).option("root", qualified(spark, folder)).option("state", qualified(spark, state)).load()


def debounced(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Bursts of the changes (tree, path, change, at), each once its tree has been quiet. Rows without path only move the watermark on."""
    # The condition names the time, so that it isn't pushed below the watermark, which would not see the other rows then.
    told = events.withWatermark("at", "0 seconds").where("case when at is not null then path is not null else false end")
    return bursts(told, "at", "tree", quiet, ("path", "change"))


def watch(spark: SparkSession, folder: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None], *, every: str = "400 milliseconds", quiet: str = QUIET, once: bool = False) -> StreamingQuery:
    """A stream that lists the tree `every` so often and calls rebuild with the changes (path, change) of each burst, when nothing has
    changed for the time `quiet`. With `once` it looks once and calls rebuild with what has changed until then, without waiting."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    events = tree_changes(own, folder, f"{checkpoint}/snapshots")

    def call(rows: DataFrame, number: int) -> None:
        changes = rows if once else rows.select(F.explode("events").alias("e")).select("e.*")
        found = last_changes(changes.where(watched(F.col("path"))))
        if not found.isEmpty():
            rebuild(found, number)

    # A query with a state can't go on as one without: each has a checkpoint of its own. The snapshots are those of the query that ran last.
    stream = events.where("path is not null") if once else debounced(events, quiet)
    writer = stream.writeStream.outputMode("append").foreachBatch(call).option("checkpointLocation", f"{checkpoint}/{'once' if once else 'clock'}")
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()
