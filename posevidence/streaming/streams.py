"""Streaming forms of tracks, counts and latest shapes.

Each takes and returns a streaming DataFrame; what it emits on a finite stream
equals its batch form. ``drained`` runs one to its end: a closing row far behind
the last event moves the watermark past every open window.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from posevidence.functions.predicates import (
    at_null_island,
    has_point,
    in_box,
    on_channels,
    position_filter,
    real_position,
)
from posevidence.materialize import new_folder
from posevidence.params import GAP_SECONDS, ExportParams

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS = "10 minutes"
#: How long after its deletion an object's state is kept for late versions.
KEPT_AFTER_DELETION = timedelta(days=1)

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table as a stream of its files; the table may be one file or a folder.

    A plain path must be a folder; a pattern may also match a single file.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def session_tracks(
    events: DataFrame, gap_seconds: int = GAP_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """Track segments per device, each emitted once it can grow no more.

    A session ends after a silence longer than the gap; a step of exactly the
    gap goes on, hence the extra microsecond.
    """
    gap = f"{gap_seconds} seconds 1 microsecond"
    session = F.session_window("servertime", gap)
    return (
        events.withWatermark("servertime", lateness)
        .groupBy("uid", session.alias("session"))
        .agg(F.count("*").alias("points"), F.min("servertime").alias("begin"), F.max("servertime").alias("end"))
        .select("uid", "begin", "end", "points")
    )


def window_counts(
    events: DataFrame, params: ExportParams, width: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Running manifest counts per device and tumbling window."""
    real = real_position()
    inside = real & in_box(params.box)
    return (
        events.withWatermark("servertime", lateness)
        .groupBy("uid", F.window("servertime", width).alias("w"))
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(real).alias("events_with_position"),
            F.count_if(at_null_island()).alias("events_at_0_0"),
            F.count_if(~has_point()).alias("events_no_geometry"),
            F.count_if(inside).alias("events_inside_box"),
            F.count_if(inside & on_channels(params.channels)).alias("events_exported"),
            F.count_if(F.coalesce(position_filter(params), F.lit(False))).alias("records"),
        )
        .select(
            "uid", F.col("w.start").alias("window_start"), "total_events", "events_with_position",
            "events_at_0_0", "events_no_geometry", "events_inside_box", "events_exported", "records",
        )
    )


# Times travel through the state as microseconds, free of any zone.
VERSION = T.StructType().add("at", "long").add("id", "long").add("cot_type", "string")
DELETION = T.StructType().add("at", "long").add("id", "long").add("mission_id", "long")
SHAPE_UPDATE = (
    T.StructType()
    .add("uid", "string").add("at", "long").add("id", "long").add("cot_type", "string")
    .add("deleted_at", "long").add("deletion_id", "long").add("deleted_in", "long")
)


class LatestShape(StatefulProcessor):
    """The newest version of one object and its first deletion.

    Two single values of state. A deletion sets a timer for when late versions
    are no longer awaited; it clears both. Only what changed is emitted.
    """

    def __init__(self, kept: timedelta = KEPT_AFTER_DELETION):
        self._kept_ms = int(kept.total_seconds() * 1000)

    def init(self, handle) -> None:
        self._handle = handle
        self._version = handle.getValueState("version", VERSION)
        self._deletion = handle.getValueState("deletion", DELETION)

    def handleInputRows(self, key, rows, timerValues):
        version = tuple(self._version.get()) if self._version.exists() else None
        deletion = tuple(self._deletion.get()) if self._deletion.exists() else None
        newest, first = version, deletion
        for row in rows:
            if row["deletes"]:
                found = (row["at"], row["id"], row["mission_id"])
                first = found if first is None or found[:2] < first[:2] else first
            else:
                found = (row["at"], row["id"], row["cot_type"])
                newest = found if newest is None or found[:2] > newest[:2] else newest
        if newest != version:
            self._version.update(newest)
        if first != deletion:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._deletion.update(first)
            self._handle.registerTimer(first[0] // 1000 + self._kept_ms)
        if (newest, first) != (version, deletion):
            yield Row(*SHAPE_UPDATE.names)(key[0], *(newest or (None,) * 3), *(first or (None,) * 3))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._version.clear()
        self._deletion.clear()
        return iter(())

    def close(self) -> None:
        pass


def shape_updates(
    versions: DataFrame, deletions: DataFrame, lateness: str = LATENESS, kept: timedelta = KEPT_AFTER_DELETION
) -> DataFrame:
    """A stream of changes: an object's row whenever its newest version or its
    first deletion is another one. ``latest_shapes`` reads the state from them.

    State is kept by object in RocksDB and ends with the object's deletion, so
    it holds the live objects and not all that ever were.
    """
    spark = versions.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    both = versions.select("uid", F.col("servertime").alias("event_time"), "id", "cot_type", F.lit(False).alias("deletes"))
    both = both.unionByName(
        deletions.select("uid", F.col("ts").alias("event_time"), "id", "mission_id", F.lit(True).alias("deletes")),
        allowMissingColumns=True,
    )
    return (
        both.withWatermark("event_time", lateness)
        .withColumn("at", F.unix_micros("event_time"))
        .groupBy("uid")
        .transformWithState(LatestShape(kept), SHAPE_UPDATE, "Update", "eventTime")
    )


def latest_shapes(updates: DataFrame) -> DataFrame:
    """The newest version of each object and its first deletion, from changes.

    Order does not matter, nor does a change that came twice, nor that an
    object drawn again long after its deletion began with empty state.
    """
    version = F.when(F.col("at").isNotNull(), F.struct("at", "id", "cot_type"))
    deletion = F.when(F.col("deleted_at").isNotNull(), F.struct("deleted_at", "deletion_id", "deleted_in"))
    state = updates.groupBy("uid").agg(F.max(version).alias("v"), F.min(deletion).alias("d"))
    return state.select(
        "uid",
        "v.id",
        F.timestamp_micros("v.at").alias("servertime"),
        "v.cot_type",
        F.timestamp_micros("d.deleted_at").alias("deleted_at"),
        "d.deleted_in",
    )


class Progress(StreamingQueryListener):
    """What one query's batches report, added up over all of them."""

    def __init__(self):
        self.late = self.batches = 0
        self.latest: datetime | None = None
        self._runs: set[str] = set()
        self._over: dict[str, threading.Event] = {}
        self._held: dict[str, list] = {}
        self._lock = threading.Lock()

    def await_end(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until ``query`` has ended and all its reports have come."""
        query.awaitTermination()
        with self._lock:
            over = self._over.setdefault(str(query.runId), threading.Event())
            for report in self._held.pop(str(query.runId), []):
                self._add(report)
            self._runs.add(str(query.runId))
        if not over.wait(seconds):
            raise TimeoutError("the query's last reports did not come")

    def _add(self, progress) -> None:
        self.batches += 1
        self.late += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        seen = progress.eventTime.get("max")
        if seen is not None:
            # Reports come in UTC with at most milliseconds.
            at = datetime.fromisoformat(seen.replace("Z", "+00:00"))
            self.latest = at if self.latest is None else max(self.latest, at)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        with self._lock:
            if run in self._runs:
                self._add(event.progress)
            else:
                self._held.setdefault(run, []).append(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._over.setdefault(str(event.runId), threading.Event()).set()


def drained(
    events: DataFrame, operator: Callable[[DataFrame], DataFrame], purpose: str,
    time: str = "servertime", beyond: timedelta = timedelta(days=1),
) -> tuple[DataFrame, int]:
    """Run ``operator`` over a finite stream to its end: (all it emits, late rows
    dropped in all its batches).

    When the input is read, a closing row without a device is appended as far
    ``beyond`` the last event as any window and lateness reach, and the same
    query goes on from its checkpoint. The closing row's own window stays open.
    """
    spark = events.sparkSession
    folder = new_folder(spark, purpose)
    closing = f"{folder}/closing"
    nothing = spark.createDataFrame([], events.schema)
    nothing.write.parquet(closing)
    out = operator(events.unionByName(spark.readStream.schema(events.schema).parquet(closing)))
    seen = _run(out, folder)
    if seen.latest is not None:
        end = (seen.latest + beyond).isoformat()
        row = [F.lit(end).cast("timestamp") if c == time else F.lit(None) for c in events.columns]
        last = spark.range(1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(row, events.schema)])
        last.coalesce(1).write.mode("append").parquet(closing)
        # Both runs append to one table; only the second one's reports are new.
        late = seen.late + _run(out, folder).late
    else:
        late = 0
    return spark.read.schema(out.schema).parquet(f"{folder}/rows"), late


def _run(stream: DataFrame, folder: str) -> Progress:
    """Append all that ``stream`` has to the folder's table, from its checkpoint."""
    progress = Progress()
    spark = stream.sparkSession
    spark.streams.addListener(progress)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{folder}/progress")
            .option("path", f"{folder}/rows")
            .trigger(availableNow=True)
            .start()
        )
        progress.await_end(query)
    finally:
        spark.streams.removeListener(progress)
    return progress


def run_updating(updates: DataFrame, folder: str) -> DataFrame:
    """Drain a stream of changes into ``folder`` and read all its changes.

    A batch writes only its own changes; a repeated one overwrites its own.
    Called again with the same folder it goes on where it stopped.
    """
    spark = updates.sparkSession
    rows = f"{folder}/rows"
    spark.createDataFrame([], updates.schema).write.mode("overwrite").parquet(f"{rows}/batch=-1")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={epoch}")

    query = (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(updates.schema).option("basePath", rows).parquet(rows).select(*updates.columns)
