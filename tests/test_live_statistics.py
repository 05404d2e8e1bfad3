"""Statistics that follow the tasks' states, and alerts by event time, as streams that stop and go on."""

import random

import pandas as pd
import pytest

from spanloom.streaming import live

STATES = "task_id string, version long, project_id string, status string, decisions array<struct<span_lower: string, type: string>>"


@pytest.fixture(autouse=True)
def store(spark):
    for key, value in live.STATE_STORE.items():
        spark.conf.set(key, value)


def test_counts_are_taken_back(spark, tmp_path):
    r = random.Random(5)
    path, inputs = str(tmp_path / "out"), str(tmp_path / "in")
    now: dict[str, tuple] = {}
    version = 0
    assert live.replaced_statistics(spark, path).count() == 0
    for step in range(4):
        batch = []
        for _ in range(40):
            version += 1
            task = f"t{r.randrange(12)}"
            state = (task, version, "p1" if task < "t5" else "p2", r.choice(["accepted", "accepted", "rejected", "qc"]), [(r.choice("abc"), r.choice("xy")) for _ in range(r.randint(0, 4))] if r.random() < 0.9 else None)
            batch.append(state)
            now[task] = state
        again = batch[:5] + ([(t, 1, "p1", "accepted", [("late", "x")]) for t in now] if step else [])  # repeated, and older than what is known
        spark.createDataFrame(batch + again, STATES).repartition(3).write.mode("append").parquet(inputs)
        query = live.replace_statistics(spark.readStream.schema(STATES).parquet(inputs), path, str(tmp_path / "at"))
        query.awaitTermination(180)
        want: dict[tuple, int] = {}
        for task, _, project, status, decisions in now.values():
            for d in set(decisions or []) if status == "accepted" else ():
                want[project, *d] = want.get((project, *d), 0) + 1
        assert {tuple(x)[:3]: x.n for x in live.replaced_statistics(spark, path).collect()} == want
        if step % 2:
            live.compact_statistics(spark, path)
            folders, old = live.statistics_folders(spark, path)
            assert len(folders) == 1 and folders[0].startswith("snapshot=")
            assert {tuple(x)[:3]: x.n for x in live.replaced_statistics(spark, path).collect()} == want
    live.compact_statistics(spark, path)
    assert live.statistics_folders(spark, path)[1] == []  # what was superfluous is gone
    assert {tuple(x)[:3]: x.n for x in live.replaced_statistics(spark, path).collect()} == want


def test_stale_alerts_with_late_and_repeated_beats(spark, tmp_path):
    inputs = str(tmp_path / "in")
    minute = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    parts = [[(1, 0), (1, 5), (2, 0), (2, 0)], [(1, 30), (2, 9), (3, 31)], [(3, 29), (1, 40), (1, 30), (2, 41)], [(9, 120)]]  # (3, 29) comes late, but before the watermark
    for k, part in enumerate(parts):
        spark.sql("select * from values " + ", ".join(f"({run}L, timestamp'{minute(m)}')" for run, m in part) + " as t(run_id, heartbeat_at)").coalesce(1).write.mode("append").parquet(inputs)
        stream = live.stale_alerts(spark.readStream.schema("run_id long, heartbeat_at timestamp").parquet(inputs), 600, "5 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(180)
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).selectExpr("run_id", f"(last_ms - unix_millis(timestamp'{minute(0)}')) div 60000").collect())
    assert got == [(1, 5), (1, 40), (2, 9), (2, 41), (3, 31)]


def test_heartbeats_of_a_run_cost_few_calls():
    """State and timers are asked once for all heartbeats of a run, not once for each."""
    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            def call(*args):
                calls.append((name, *args))
                if name == "update":
                    self.value = args[0]
                if name == "clear":
                    self.value = None
                return {"exists": self.value is not None, "get": self.value}.get(name)

            return call

    class Timer:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        def getCurrentWatermarkInMs(self):
            return 10_000_000

    handle, processor = Handle(), live.HeartbeatProcessor(5)
    processor.init(handle)
    assert list(processor.handleInputRows((1,), iter([pd.DataFrame({"at_ms": [k * 10_000 for k in range(1000)]})]), None)) == []
    (timer,) = [c[1] for c in calls if c[0] == "registerTimer"]
    out = pd.concat(processor.handleExpiredTimer((1,), Timer(timer), Timer(timer)))
    assert out["last_ms"].tolist() == [k * 10_000 for k in range(1000)] and handle.value is None and len(calls) < 12
