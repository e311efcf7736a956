"""Stream queries; every function takes a batch or a streaming table unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxledger import constants as K
from voxledger.functions.numbers import present
from voxledger.operators import indicators as I
from voxledger.operators.synthesis import merge_intervals

TERMINAL = ("completed", "failed")


def sessions(access: DataFrame, key: str = "session_id", ts: str = "ts", minutes: int = K.SESSION_MINUTES, late: str = "10 minutes") -> DataFrame:
    """Inactivity sessions: closed once ``minutes`` pass without access.

    As a stream this is a session window with a watermark.  As a batch, accesses
    are first counted per quarter of an hour (or per gap, if shorter): accesses
    of one slot can never be in different sessions, so a busy key is reduced to
    its slots before they are merged, and merged piecewise if it is still hot.
    """
    if not access.isStreaming:
        return _batch_sessions(access, key, ts, minutes)
    d = access.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n_access"), F.max(ts).alias("last_accessed")
    )
    return d.select(key, F.col("w.start").alias("created_at"), "last_accessed", F.col("w.end").alias("expires_at"), "n_access")


def _batch_sessions(access: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    gap = minutes * 60_000_000
    slot = min(gap, 900_000_000)
    slots = (
        access.select(key, F.unix_micros(ts).alias("_us"))
        .groupBy(key, F.floor(F.col("_us") / slot).alias("_slot"))
        .agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count(F.lit(1)).alias("_n"))
    )
    merged = merge_intervals(slots, [key], "_from", "_to", gap, {"n_access": F.sum("_n")})
    at = {"created_at": "t_start", "last_accessed": "t_end", "expires_at": f"t_end + {gap}"}
    return merged.select(key, *[F.expr(f"timestamp_micros({e})").alias(n) for n, e in at.items()], "n_access")


def latest_progress(events: DataFrame, total_stages: int = 6) -> DataFrame:
    """Latest status per job; a terminal status wins over anything later.

    ``max_by`` combines on the map side.  As a stream this runs in update or
    complete mode.
    """
    terminal = F.expr(f"status IN {TERMINAL}").cast("int")
    row = F.struct("stage_index", "status", "ts")
    d = events.groupBy("job_id").agg(F.max_by(row, F.struct(terminal, "ts", "stage_index")).alias("r"))
    pct = F.expr(f"if(r.status = 'completed', 100, least(99, CAST(round((r.stage_index + 1) * 100D / {total_stages}) AS INT)))")
    return d.select("job_id", "r.stage_index", "r.status", F.col("r.ts").alias("updated_at"), pct.alias("progress_pct"))


def unexpired(jobs: DataFrame, now: Column | str, seconds: int = K.JOB_EXPIRY_SECONDS) -> DataFrame:
    """Jobs that are running, or finished no longer than ``seconds`` before ``now``."""
    now = F.expr(now) if isinstance(now, str) else now
    age = F.unix_micros(now) - F.unix_micros("updated_at")
    return jobs.where(~F.col("status").isin(*TERMINAL) | (age <= F.lit(seconds * 1_000_000)))


def active_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def live_scan(frames: DataFrame, late: str = "2 seconds", length: str = "1.5 seconds", hop: str = "0.5 seconds") -> DataFrame:
    """Energy of each sliding window over arriving frames ``(clip_id, ts, rms)``."""
    d = frames.withWatermark("ts", late) if frames.isStreaming else frames
    return (
        d.groupBy("clip_id", F.window("ts", length, hop).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_frames"), F.avg("rms").alias("mean_rms"), F.stddev_pop("rms").alias("std_rms"))
        .select(
            "clip_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n_frames", "mean_rms",
            (F.col("std_rms") / (F.col("mean_rms") + F.lit(1e-8))).alias("energy_cv"),
        )
    )


class _InOrder(StatefulProcessor):
    """Windows of a clip in their order, each with the vector distance and the quiet level of the one before.

    A window waits in a map until the watermark has passed its end, when no earlier
    one can come any more.  The last window that left is kept for ``idle_ms`` of
    event time; a clip that goes on later starts anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "window_id bigint", "end_ms bigint, v array<double>, quiet double, metrics array<double>")
        self.last = handle.getValueState("last", "end_ms bigint, v array<double>, quiet double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ends = [int(pd.Timestamp(t).value // 1_000_000) for t in pdf["end_time"]]
            for w, end, v, quiet, metrics in zip(pdf["window_id"], ends, pdf["v"], pdf["quiet_rms"], pdf["metrics"]):
                self.waiting.updateValue((int(w),), (end, _numbers(v), _number(quiet), _numbers(metrics)))
                self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((row[0], w[0], *row[1:]) for w, row in self.waiting.iterator() if row[0] <= now)
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for end, w, v, quiet, metrics in ready:
            if before is not None and end - before[0] > self.idle_ms:
                before = None
            both = before is not None and v is not None and before[1] is not None
            dist = float(np.linalg.norm(np.subtract(v, before[1], dtype=float))) if both else None
            out.append((key[0], w, pd.Timestamp(end, unit="ms"), quiet, before and before[2], dist, metrics))
            before = (end, v, quiet)
            self.waiting.removeKey((w,))
        if ready:
            self.last.update(before)
            self.handle.registerTimer(before[0] + self.idle_ms)
        elif before is not None and before[0] + self.idle_ms <= now:
            self.last.clear()
        yield pd.DataFrame(out, columns=["clip_id", "window_id", "end_time", "quiet_rms", "prev_quiet_rms", "mfcc_dist", "metrics"])

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def _numbers(v) -> list | None:
    return None if v is None else [_number(x) for x in v]


def live_distances(windows: DataFrame, late: str = "2 seconds", idle: int = 60) -> DataFrame:
    """Streaming table ``(clip_id, window_id, end_time, v[, quiet_rms, metrics])``: distance to the previous window of the clip.

    Windows may come in any order within the watermark and leave in theirs once it
    has passed their end; later ones are dropped as late.  A window that comes
    again while it waits replaces itself; one without a vector has no distance, nor
    has its successor.  Needs the RocksDB state store.  ``idle`` is in seconds.
    """
    kt = windows.schema["clip_id"].dataType.simpleString()
    more = {"quiet_rms": F.lit(None).cast("double"), "metrics": F.array().cast("array<double>")}
    d = windows.withColumns({n: c for n, c in more.items() if n not in windows.columns})
    return d.select("clip_id", F.col("window_id").cast("bigint"), "end_time", "v", "quiet_rms", "metrics").withWatermark("end_time", late).groupBy("clip_id").transformWithStateInPandas(
        statefulProcessor=_InOrder(idle * 1000),
        outputStructType=f"clip_id {kt}, window_id bigint, end_time timestamp, quiet_rms double, prev_quiet_rms double, mfcc_dist double, metrics array<double>",
        outputMode="Append",
        timeMode="EventTime",
    )


METRICS = ["hf_ripple", "hnr_db", "phase_var", "pitch_entropy", "micro_jitter", "energy_cv"]


def live_scores(windows: DataFrame, baseline: DataFrame | None = None, boundary_mode: str = "detected", late: str = "2 seconds", idle: int = 60) -> DataFrame:
    """Vocoder, spectral and prosody score, boundary flag and checks of each window as it is complete.

    ``windows``: a streaming or batch table ``clip_id, window_id, end_time,
    mfcc_mean, quiet_rms`` and METRICS.  ``baseline``: a table ``clip_id, mu,
    sigma``, since a running clip has none of its own yet; a clip without one gets
    that of a clip below two chunks.  Missing metrics give the fallback scores.
    """
    if windows.isStreaming:
        d = live_distances(windows.select("clip_id", "window_id", "end_time", F.col("mfcc_mean").alias("v"), "quiet_rms", F.array(*METRICS).alias("metrics")), late, idle)
        d = d.select("*", *[F.get("metrics", F.lit(i)).alias(n) for i, n in enumerate(METRICS)]).drop("metrics")
    else:
        d = I.cross_window(windows)
    if baseline is None:
        d = d.withColumns({"mu": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double")})
    else:
        d = d.join(baseline.select("clip_id", "mu", "sigma"), "clip_id", "left")
    d = I.spectral_scores(d.fillna({"mu": 30.0, "sigma": 10.0}), boundary_mode)
    v, p = [F.col(n) for n in METRICS[:3]], [F.col(n) for n in METRICS[3:]]
    found = F.coalesce("spectral_checks", F.array().cast("array<string>"))
    return I.fallback_scores(
        d.select(
            "clip_id", "window_id", "end_time", I.vocoder_score(*v).alias("vocoder_score"), "spectral_score", "raw_score", I.prosody_score(*p).alias("prosody_score"),
            "boundary_detected", "room_change", F.concat(present(*I.vocoder_checks(*v)), found, present(*I.prosody_checks(*p))).alias("triggered_checks"),
        )
    )


class _JobState(StatefulProcessor):
    """Last status per job; a finished job is forgotten ``seconds`` after its last event."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "stage_index int, status string, ts_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.state.get()) if self.state.exists() else None
        for pdf in rows:
            for stage, status, ts in zip(pdf["stage_index"], pdf["status"], pdf["ts"]):
                new = (int(stage), str(status), int(pd.Timestamp(ts).value // 1_000_000))
                if best is None or _rank(new) >= _rank(best):
                    best = new
        if best is not None:
            self.state.update(best)
            if best[1] in TERMINAL:
                self.handle.registerTimer(best[2] + self.seconds * 1000)
            yield pd.DataFrame([(key[0], *best)], columns=["job_id", "stage_index", "status", "updated_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=["job_id", "stage_index", "status", "updated_ms"])

    def close(self) -> None:
        pass


def _rank(job: tuple) -> tuple:
    return (job[1] in TERMINAL, job[2], job[0])


def live_jobs(events: DataFrame, seconds: int = K.JOB_EXPIRY_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming table of job events: latest status per job, in update mode.

    State is dropped by event-time timers, so it is bounded by the jobs that are
    running or finished lately.
    """
    kt = events.schema["job_id"].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_JobState(seconds),
        outputStructType=f"job_id {kt}, stage_index int, status string, updated_ms bigint",
        outputMode="Update",
        timeMode="EventTime",
    )


BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def arrivals(files: DataFrame) -> DataFrame:
    """Files as ``path, modificationTime, length, content_md5``: what comes after keeps no bytes, in shuffles or in state."""
    return files.select("path", "modificationTime", "length", F.md5("content").alias("content_md5"))


def ingest_recordings(spark: SparkSession, path: str, files_per_batch: int = 1000, late: str = "1 hour") -> DataFrame:
    """New recordings as they arrive, each content once within the watermark; ``with_content`` reads those that are kept."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return arrivals(files).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["content_md5"])


def ingested(files: DataFrame) -> DataFrame:
    """The batch twin: of each content the first path, the latest change, and how often it came."""
    return arrivals(files).groupBy("content_md5").agg(
        F.min("path").alias("path"), F.max("modificationTime").alias("modificationTime"), F.first("length").alias("length"), F.count(F.lit(1)).alias("copies")
    )


def with_content(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """Bytes of the files of one micro-batch, read again; a batch has at most ``files_per_batch`` rows."""
    paths = [r["path"] for r in batch.select("path").collect()]
    if not paths:
        return batch.withColumn("content", F.lit(None).cast("binary")).limit(0)
    # names may hold what a pattern would take for a wildcard
    files = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths])
    return batch.join(files.select("path", "content"), "path")


def with_quality_metrics(df: DataFrame, name: str | Observation, rejected: str = "reject_reason") -> DataFrame:
    """Count rows and rejects while the query runs (``observe``)."""
    return df.observe(
        name, F.count(F.lit(1)).alias("rows_in"), F.count(rejected).alias("rejected"),
        (F.count(F.lit(1)) - F.count(rejected)).alias("accepted"),
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drain what is available now, handing each micro-batch to ``sink``."""
    q = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
