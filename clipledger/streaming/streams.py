"""Streaming forms of the time-ordered operators. Timestamps are instants; every stream has a watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clipledger.operators.aggregates import decide


def stream_runs(sdf: DataFrame, by: Sequence[str], ts: str, gap: str, delay: str, **aggs: Column) -> DataFrame:
    """Runs separated by more than ``gap``: start, end (of the last row), rows and further aggregates. Rows later than
    the watermark are dropped, unlike in the batch form."""
    w = sdf.withWatermark(ts, delay).groupBy(*by, F.session_window(ts, gap).alias("run"))
    d = w.agg(F.count("*").alias("rows"), F.max(ts).alias("last"), *[a.alias(n) for n, a in aggs.items()])
    return d.select(*by, F.col("run.start").alias("start"), "last", "rows", *aggs)


def stream_hints(sdf: DataFrame, by: Sequence[str], ts: str, kind: str, confidence: str, size: str, delay: str, slide: str | None = None, minimum: float = 0.20) -> DataFrame:
    """Evidence per (group, window, kind) above a confidence floor: rows, mean and highest confidence. See
    :func:`decide_hints` for the winner."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    d = sdf.withWatermark(ts, delay).where(F.col(confidence) >= minimum)
    d = d.groupBy(*by, win.alias("w"), kind).agg(F.count("*").alias("rows"), F.avg(confidence).alias("mean_confidence"), F.max(confidence).alias("best_confidence"))
    return d.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "rows", "mean_confidence", "best_confidence")


def stream_jobs(sdf: DataFrame, job: str, event: str, ts: str, status: str, delay: str) -> DataFrame:
    """Latest status per job (update mode): duplicated events within the watermark count once."""
    d = sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark([job, event])
    latest = F.max(F.struct(F.col(ts).alias("ts"), F.col(status).alias("status")))
    return d.groupBy(job).agg(latest.alias("_l"), F.count("*").alias("events"), F.count(F.when(F.col(status) == "started", 1)).alias("attempts")).select(job, F.col("_l.status").alias("status"), F.col("_l.ts").alias("updated"), "events", "attempts")


#: Kinds of job events; fixed values.
STARTED, COMPLETED, FAILED = "started", "completed", "failed"


def _job_state(stages: Sequence[str], patience_ms: int | None, memory_ms: int):
    from pyspark.sql.streaming import StatefulProcessor

    class JobState(StatefulProcessor):
        """What a job's manifest holds: its status and active stage, a record per stage, the artifacts of completed
        stages, and for a while the ids of events, so that one delivered again counts once."""

        def init(self, handle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "status string, stage string, updated long, events long, heard long")
            self.stages = handle.getMapState("stages", "stage string", "status string, attempts long, outputs string")
            self.artifacts = handle.getMapState("artifacts", "key string", "digest string, stage string")
            self.seen = handle.getMapState("seen", "event string", "at long")

        def _clear(self) -> None:
            for state in (self.job, self.stages, self.artifacts, self.seen):
                state.clear()

        def handleInputRows(self, key, rows, timerValues):
            known = self.job.exists()
            status, active, updated, events, heard = self.job.get() if known else (None, None, 0, 0, 0)
            # a call of the state store costs more than an event: small states are read and written once a batch, and
            # ids are looked up only where the store may hold them
            ran = {k[0]: (v[0], int(v[1]), v[2] or "") for k, v in self.stages.iterator()} if known else {}
            held = {k[0]: (v[0], v[1]) for k, v in self.artifacts.iterator()} if known else {}
            ran_before, held_before, ids = dict(ran), dict(held), {}
            new = pd.concat(list(rows)).sort_values(["us", "event"], kind="stable")
            for r in new.itertuples(index=False):
                if patience_ms is not None and heard and int(r.us) > heard + patience_ms * 1000:
                    self._clear()
                    status, active, events, known = None, None, 0, False
                    ran, held, ran_before, held_before, ids = {}, {}, {}, {}, {}
                if r.event in ids or known and self.seen.containsKey((r.event,)):
                    continue
                ids[r.event] = int(r.us)
                events, updated, heard = events + 1, int(r.us), max(heard, int(r.us))
                old = ran.get(r.stage, ("pending", 0, ""))
                if r.kind == STARTED:  # take back what the stage has produced, before it runs anew
                    for k in old[2].split("\n"):
                        if k in held and held[k][1] == r.stage:
                            del held[k]
                    ran[r.stage] = ("running", old[1] + 1, "")
                    status, active = "running", r.stage
                elif r.kind == COMPLETED:
                    made = dict(zip(r.keys, r.digests))
                    held.update({k: (d, r.stage) for k, d in made.items()})
                    outputs = sorted({*[x for x in old[2].split("\n") if x], *made})
                    ran[r.stage] = (COMPLETED, old[1], "\n".join(outputs))
                    over = all(s in ran and ran[s][0] == COMPLETED for s in stages)
                    status, active = COMPLETED if over else "running", None
                elif r.kind == FAILED:
                    ran[r.stage] = (FAILED, old[1], old[2])
                    status, active = FAILED, r.stage
            for k, us in ids.items():
                self.seen.updateValue((k,), (us,))
            for state, now, before in ((self.stages, ran, ran_before), (self.artifacts, held, held_before)):
                for k in before.keys() - now.keys():
                    state.removeKey((k,))
                for k, v in now.items():
                    if before.get(k) != v:
                        state.updateValue((k,), v)
            self.job.update((status, active, updated, events, heard))
            # ids are forgotten once no copy can arrive in time, silent jobs when the caller says so
            self.handle.registerTimer(heard // 1000 + memory_ms)
            if patience_ms is not None:
                self.handle.registerTimer(heard // 1000 + patience_ms)
            yield pd.DataFrame({
                "job": [key[0]], "status": [status], "active_stage": [active], "updated_us": [updated], "events": [events], "attempts": [[ran.get(s, ("", 0))[1] for s in stages]],
                "artifacts": [sorted(f"{k}={v[0]}" for k, v in held.items())]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.job.exists():
                now, heard = expiredTimerInfo.getExpiryTimeInMs(), int(self.job.get()[4]) // 1000
                due = {k: int(v[0]) // 1000 + memory_ms <= now for k, v in self.seen.iterator()}
                if all(due.values()):
                    self.seen.clear()
                else:
                    for k in [k for k, over in due.items() if over]:
                        self.seen.removeKey(k)
                if patience_ms is not None and heard + patience_ms <= now:
                    self._clear()
            return iter([])

        def close(self) -> None:
            pass

    return JobState()


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that streams with several states need, for streams started within."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_job_state(sdf: DataFrame, job: str, event: str, ts: str, kind: str, stage: str, artifacts: str, stages: Sequence[str], delay: str, memory_ms: int, patience_ms: int | None = None) -> DataFrame:
    """The state of every job that an update-mode batch has events of: ``status`` (running, completed when all ``stages``
    are, failed), ``active_stage``, ``updated_us``, ``events``, ``attempts`` per stage in the order of ``stages``, and
    ``artifacts`` (``key=digest``, sorted). ``artifacts`` of an event is an array of structs (key, digest).

    A started stage gives up what it produced before and counts an attempt; a completed one registers its artifacts
    under their keys, the last digest stays. Events of a batch are applied by time, then id; later batches follow
    earlier ones. An event id counts once within ``memory_ms`` of event time; later the id is forgotten. A job that is
    silent for ``patience_ms`` is forgotten whole and starts anew when it resumes, so the state is bounded by the jobs of that time; without it,
    jobs stay. The session needs the RocksDB state store.
    """
    name = sdf.schema[job].dataType.simpleString()
    d = sdf.withWatermark(ts, delay).where(F.col(job).isNotNull() & F.col(ts).isNotNull())
    own = F.coalesce(artifacts, F.array().cast(sdf.schema[artifacts].dataType))
    d = d.select(F.col(job).alias("job"), ts, F.unix_micros(F.col(ts)).alias("us"), F.col(event).cast("string").alias("event"), F.col(kind).alias("kind"), F.coalesce(stage, F.lit("")).alias("stage"),
                 F.transform(own, lambda a: a["key"]).alias("keys"), F.transform(own, lambda a: a["digest"]).alias("digests"))
    return d.groupBy("job").transformWithStateInPandas(
        _job_state(list(stages), patience_ms, memory_ms), f"job {name}, status string, active_stage string, updated_us long, events long, attempts array<long>, artifacts array<string>", "Update", "EventTime")


def decide_hints(rows: DataFrame, by: Sequence[str], kind: str, frames: str = "frames", **limits) -> DataFrame:
    """Winner per group and window of closed hint rows (see :func:`stream_hints`): score, runner-up, margin and the
    reasons to abstain, as in the batch decision. All kinds of a window close in the same micro-batch, so this may be
    the ``build`` step of a publishing stream."""
    keys = [*by, "start", "end"]
    n = rows.groupBy(*keys).agg(F.max(frames).alias("n_frames"))
    return decide(rows.withColumnsRenamed({"rows": "support_frames", "mean_confidence": "_mean"}).drop("best_confidence", frames), keys, kind, n, **limits)


def _cadence(by: str, interval: float, max_n: int, patience_ms: int | None):
    """State per clip: next grid number, frames emitted and frames seen. Times are computed for the whole batch; the
    walk goes from one emitted frame to the next, at most ``max_n`` steps, by search."""

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        nxt, sent, seen = state.get if state.exists else (0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values(["device_s", "frame"])
        steady = (seen + np.arange(len(pdf))) / pdf["rate"].to_numpy()
        device = pdf["device_s"].to_numpy()
        t = np.where(device >= steady * 0.5, device, steady)  # a stale device clock is replaced
        reach = np.maximum.accumulate(t + 0.5 / pdf["rate"].to_numpy())
        at, out = 0, []
        while sent < max_n and at < len(t):
            at += int(np.searchsorted(reach[at:], nxt * interval, side="left"))
            while at < len(t) and t[at] + 0.5 / pdf["rate"].iloc[at] < nxt * interval:
                at += 1  # a frame behind an earlier, later one
            if at == len(t):
                break
            out.append((key[0], int(pdf["frame"].iloc[at]), float(t[at]), sent))
            sent, nxt, at = sent + 1, max(nxt + 1, int(t[at] // interval) + 1), at + 1
        state.update((nxt, sent, seen + len(pdf)))
        if patience_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + patience_ms)
        yield pd.DataFrame(out, columns=[by, "frame", "timestamp_s", "candidate_index"])

    return step


def stream_cadence(sdf: DataFrame, by: str, ts: str, frame: str, device: str, sample_fps: float, source_fps: float | Column, max_n: int, delay: str, patience_ms: int | None = None) -> DataFrame:
    """Cadence sampler with state per clip. ``source_fps`` is one rate or the clip's own. A clip's state is three numbers
    and is kept for good, unless ``patience_ms`` names the event time after which a silent clip is forgotten; one that
    resumes later then starts anew.

    Each micro-batch holds a bounded part of a clip, which is sorted by time inside the batch.
    """
    kind = sdf.schema[by].dataType.simpleString()
    rate = F.lit(float(source_fps)) if isinstance(source_fps, (int, float)) else source_fps
    d = sdf.withWatermark(ts, delay).select(by, ts, F.col(frame).cast("long").alias("frame"), F.col(device).cast("double").alias("device_s"), rate.cast("double").alias("rate"))
    return d.groupBy(by).applyInPandasWithState(
        _cadence(by, 1 / sample_fps, max_n, patience_ms), f"`{by}` {kind}, frame long, timestamp_s double, candidate_index int",
        "nxt long, sent long, seen long", "append", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.EventTimeTimeout)


def stream_publish(sdf: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append"):
    """Publish each micro-batch under its own id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = build(batch) if build else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def run_once(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append", build: Callable | None = None) -> DataFrame:
    """Process everything available and return what was published, with the id of its batch."""
    q = stream_publish(sdf, path, checkpoint, build, mode).trigger(availableNow=True).start()
    q.awaitTermination()
    spark: SparkSession = sdf.sparkSession
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


def closable(sdf: DataFrame, folder: str) -> DataFrame:
    """The stream joined with an empty one from ``folder``, by which :func:`run_to_end` can close it."""
    spark: SparkSession = sdf.sparkSession
    spark.createDataFrame([], sdf.schema).write.parquet(folder)
    return sdf.unionByName(spark.readStream.schema(sdf.schema).parquet(folder))


def run_to_end(sdf: DataFrame, ts: str, end, folder: str, source: DataFrame, path: str, checkpoint: str, build: Callable | None = None) -> DataFrame:
    """Like :func:`run_once`, and then close what the watermark holds open: when all rows have been read, a row with
    nothing but the time ``end`` arrives in ``folder`` (see :func:`closable`, whose result is ``source``) and moves the
    watermark past every window. Its own window stays open and is never published."""
    run_once(sdf, path, checkpoint, build=build)
    spark: SparkSession = sdf.sparkSession
    blank = [F.lit(end).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    spark.range(1).select(*blank).write.mode("append").parquet(folder)
    return run_once(sdf, path, checkpoint, build=build)


def latest_per_key(published: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last published row per key of an update-mode stream."""
    cols = [c for c in published.columns if c not in (*key, "batch_id")]
    return published.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch_id").alias("_l")).select(*key, "_l.*")
