"""Structured Streaming twins of batch operators. Each takes streaming DataFrames and returns one; the caller starts the query."""

from __future__ import annotations

import json
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spanloom.operators.conventions import row_hits
from spanloom.operators.graph import complete_folders, removed

#: What a session needs for the operators that keep state of their own.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def row_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def throughput(attempts: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Succeeded attempts per stage and window of their end; those later than the watermark are left out."""
    w = F.window("finished_at", width, slide) if slide else F.window("finished_at", width)
    own = attempts.where("status = 'succeeded' and dur_s > 0").withWatermark("finished_at", late)
    return own.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n")).select("w.start", "w.end", "stage", "n")


def sessions(attempts: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of attempts of a task without a gap that long."""
    own = attempts.withWatermark("finished_at", late)
    return own.groupBy(F.session_window("finished_at", gap).alias("w"), "task_id").agg(F.count("*").alias("n")).select("task_id", "w.start", "w.end", "n")


def first_rows(rows: DataFrame, time_col: str, late: str = "1 hour") -> DataFrame:
    """Rows whose text hasn't come within the watermark before."""
    return rows.withColumn("content_hash", F.sha2("input", 256)).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["content_hash"])


def convention_hits(rows: DataFrame, conventions: DataFrame) -> DataFrame:
    """Arriving rows with each active convention that their text holds, found as in a batch: by automata of the conventions as they stand when
    the stream is started, and without state."""
    return row_hits(rows, conventions.where("status = 'active'"), least_length=1).select("span_lower", "task_id", "row_index", "convention")


def event_histogram(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and status."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "next_status").agg(F.count("*").alias("n")).select("w.start", "next_status", "n")


def keep_statistics(decisions: DataFrame, path: str, checkpoint: str):
    """Starts a query that adds each accepted task's decisions (task_id, span_lower, type, ts) to the statistics at path, once per decision.

    Every batch writes its own counts into a folder of its number, so a batch that runs again replaces what it wrote before; readers sum.
    """
    once = decisions.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["task_id", "span_lower", "type"])

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("span_lower", "type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StatusProcessor(StatefulProcessor):
    """Per task its last status; each event gives whether its move is allowed and follows the status before."""

    def __init__(self, allowed: set[tuple[str, str]]):
        self.allowed = allowed

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "status string, seq long")

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(rows).sort_values("seq")
        status, seq = self.state.get() if self.state.exists() else ("draft", 0)
        out = []
        for e in events.itertuples():
            if e.seq > seq:  # an event that comes again changes nothing
                out.append((key[0], int(e.seq), e.previous_status, e.next_status, (e.previous_status, e.next_status) in self.allowed, e.previous_status == status))
                status, seq = e.next_status, int(e.seq)
        self.state.update((status, seq))
        if out:
            yield pd.DataFrame(out, columns=["task_id", "seq", "previous_status", "next_status", "legal", "chained"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Each event (task_id, seq, previous_status, next_status) once, with legal and chained; the last row of a task is its current status, and
    those that aren't both are the side output of bad moves. State is one row for each task."""
    return events.groupBy("task_id").transformWithStateInPandas(StatusProcessor(set(allowed)), "task_id string, seq long, previous_status string, next_status string, legal boolean, chained boolean", "Append", "None")


def bad_moves(changes: DataFrame) -> DataFrame:
    return changes.where("not legal or not chained")


class HeartbeatProcessor(StatefulProcessor):
    """Keeps a run's heartbeats until the watermark is past the time in which another should follow, and then tells which had none. The state is
    read and written once for all of a run's heartbeats, and a run has one timer, for its earliest heartbeat. Late ones may
    still fill a gap, and the state holds no more than the watched time and what the watermark waits for."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "at array<long>")

    def handleInputRows(self, key, rows, timerValues):
        before = list(self.beats.get()[0]) if self.beats.exists() else []
        beats = sorted({*before, *(at for frame in rows for at in frame["at_ms"].tolist())})  # a heartbeat that comes again changes nothing
        self.beats.update((beats,))
        if not before or beats[0] < before[0]:
            self.handle.registerTimer(beats[0] + self.millis)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        beats = list(self.beats.get()[0]) if self.beats.exists() else []
        done = bisect_right(beats, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.millis)
        if not done:  # the timer of a heartbeat that went with an earlier one's
            return
        if done < len(beats):
            self.beats.update((beats[done:],))
            self.handle.registerTimer(beats[done] + self.millis)
        else:
            self.beats.clear()
        following = [*beats[1:], None]
        last = [at for at, other in zip(beats[:done], following) if other is None or other > at + self.millis]
        if last:
            yield pd.DataFrame({"run_id": key[0], "last_ms": last})

    def close(self) -> None:
        pass


def stale_alerts(heartbeats: DataFrame, seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """run_id, last_ms: each heartbeat of a run (run_id, heartbeat_at) that no other follows within that long, once the watermark is past it. Heartbeats
    may come again, and late by as much as the watermark waits. A run that beats again afterwards is watched anew."""
    own = heartbeats.withWatermark("heartbeat_at", late).select("run_id", "heartbeat_at", F.unix_millis("heartbeat_at").alias("at_ms"))
    return own.groupBy("run_id").transformWithStateInPandas(HeartbeatProcessor(seconds), "run_id long, last_ms long", "Append", "EventTime")


class ContributionProcessor(StatefulProcessor):
    """Per task what it now adds to the statistics; each newer version gives the differences to that, so that counts are taken back as well."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("counted", "version long, items string")

    def handleInputRows(self, key, rows, timerValues):
        version, counted = (-1, set())
        if self.state.exists():
            version, items = self.state.get()
            counted = {tuple(x) for x in json.loads(items)}
        before = set(counted)
        events = pd.concat(rows).sort_values("version")
        for e in events.itertuples():
            if e.version > version:  # versions that come again, or after a newer one, change nothing
                version = int(e.version)
                counted = {(e.project_id, d["span_lower"], d["type"]) for d in e.decisions} if e.status == "accepted" and e.decisions is not None else set()
        self.state.update((version, json.dumps(sorted(counted))))
        changes = [(*x, 1) for x in sorted(counted - before)] + [(*x, -1) for x in sorted(before - counted)]
        if changes:
            yield pd.DataFrame(changes, columns=["project_id", "span_lower", "type", "delta"])

    def close(self) -> None:
        pass


def statistics_changes(states: DataFrame) -> DataFrame:
    """project_id, span_lower, type, delta: how each change of a task (task_id, version, project_id, status, decisions array<struct<span_lower, type>>) moves
    the counts of accepted tasks: 1 for what it adds, -1 for what it takes back. State is one row for each task: the decisions that it has
    in the counts."""
    return states.groupBy("task_id").transformWithStateInPandas(ContributionProcessor(), "project_id string, span_lower string, type string, delta long", "Append", "None")


COUNTED = ["project_id", "span_lower", "type"]


def replace_statistics(states: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps the statistics at path in step with the tasks' states. A batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*COUNTED).agg(F.sum("delta").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return statistics_changes(states).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics_folders(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The folders whose counts add up to the statistics: the last snapshot and the batches after it; and those that it has made superfluous."""
    found = [(kind, int(number)) for kind, number in (name.split("=") for name in complete_folders(spark, path) if "=" in name)]
    last = max([number for kind, number in found if kind == "snapshot"], default=-1)
    live = [f"{kind}={number}" for kind, number in found if number > last and kind == "batch" or number == last and kind == "snapshot"]
    return live, [name for kind, number in found if (name := f"{kind}={number}") not in live]


def replaced_statistics(spark: SparkSession, path: str) -> DataFrame:
    """project_id, span_lower, type, n of the accepted tasks, as replace_statistics() has left it."""
    folders, _ = statistics_folders(spark, path)
    schema = "project_id string, span_lower string, type string, n long"
    parts = spark.read.schema(schema).parquet(*(f"{path}/{x}" for x in folders)) if folders else spark.createDataFrame([], schema)
    return parts.groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")


def compact_statistics(spark: SparkSession, path: str) -> None:
    """Adds the batches so far up in one snapshot. What an earlier snapshot has made superfluous goes; what this one has goes at the next
    call, so that readers that have begun can end."""
    folders, old = statistics_folders(spark, path)
    batches = [int(x.split("=")[1]) for x in folders if x.startswith("batch=")]
    if batches:
        replaced_statistics(spark, path).write.mode("overwrite").parquet(f"{path}/snapshot={max(batches)}")
    for name in old:
        removed(spark, f"{path}/{name}")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("span_lower", "type").agg(F.sum("n").alias("n"))
