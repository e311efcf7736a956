"""Streams replayed from files give what the batch gives."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF, wav_bytes
from voxledger.catalog.bindings import b_access, b_jobs
from voxledger.session import shared_dir
from voxledger.streaming import streams as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def replay(spark, df, parts: int, order: str):
    """Write ``df`` as files in ``order`` and read them as a stream, one per batch."""
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    for p in range(parts):
        df.withColumn("_p", F.ntile(parts).over(Window.orderBy(order))).where(f"_p = {p + 1}").drop("_p").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, mode="append"):
    out = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    seen = []
    S.run_to_end(stream, lambda d, i: (seen.append(i), d.write.mode("append").parquet(out)), f"{out}-checkpoint", mode)
    assert seen
    return spark.read.parquet(out)




def test_sessions(spark):
    acc = b_access(spark, SF).where("session_id < 6")
    last = spark.createDataFrame([(999, dt.datetime(2030, 1, 1))], "session_id long, ts timestamp")
    stream = replay(spark, acc.unionByName(last), 3, "ts")
    got = drained(spark, S.sessions(stream)).where("session_id < 999")
    want = S.sessions(acc)
    assert got.count() == want.count() > 100
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_session_edge(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=1800)), ("b", t), ("b", t + dt.timedelta(seconds=1800, microseconds=1))]
    d = S.sessions(spark.createDataFrame(rows, "session_id string, ts timestamp"))
    assert {r["session_id"]: r["n_access"] for r in d.groupBy("session_id").agg(F.max("n_access").alias("n_access")).collect()} == {"a": 2, "b": 1}


def test_live_scan(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(c, t + dt.timedelta(milliseconds=16 * i), float((i * 7 + c) % 11)) for c in range(3) for i in range(300)]
    fr = spark.createDataFrame(rows, "clip_id int, ts timestamp, rms double")
    end = spark.createDataFrame([(99, t + dt.timedelta(hours=1), 0.0)], "clip_id int, ts timestamp, rms double")
    got = drained(spark, S.live_scan(replay(spark, fr.unionByName(end), 4, "ts"))).where("clip_id < 99")
    r = [F.round(c, 9).alias(c) for c in ("mean_rms", "energy_cv")]
    cols = ["clip_id", "start_time", "end_time", "n_frames", *r]
    want = S.live_scan(fr)
    assert got.count() == want.count() > 20 and got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_late_frames_are_dropped(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "clip_id int, ts timestamp, rms double"
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    # the watermark drops rows from the second batch after the one that moved it
    for rows in ([(1, t, 1.0)], [(1, t + dt.timedelta(minutes=5), 1.0)], [(1, t + dt.timedelta(minutes=6), 1.0)], [(1, t + dt.timedelta(seconds=1), 9.0)], [(1, t + dt.timedelta(hours=1), 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    got = drained(spark, S.live_scan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)))
    assert got.where("mean_rms > 1").count() == 0 and got.where(F.col("start_time") <= F.lit(t)).count() == 3


T0 = dt.datetime(2024, 1, 1)


def live_windows(spark, clips=2, n=12, seed=1):
    """Windows with all metrics, a missing vector and missing metrics among them, and a far end that moves the watermark."""
    rng = np.random.default_rng(seed)
    rows = [
        (c, w, T0 + dt.timedelta(seconds=1.5 + 0.5 * w), None if (c, w) == (1, 5) else rng.normal(size=3).tolist(), float(rng.uniform(0, 0.05)),
         *[None if (c, w) == (0, 7) else float(x) for x in rng.uniform((0.2, 5, 0.3, 1, 0.1, 0.1), (0.9, 35, 4, 3, 4.5, 0.6))])
        for c in range(clips) for w in range(n)
    ]
    end = [(99, 0, T0 + dt.timedelta(hours=k), [0.0] * 3, 0.0, *[0.5] * 6) for k in (1, 2)]
    schema = "clip_id int, window_id long, end_time timestamp, mfcc_mean array<double>, quiet_rms double, " + ", ".join(f"{m} double" for m in S.METRICS)
    return spark.createDataFrame(rows, schema), spark.createDataFrame(end, schema)


def shuffled_stream(spark, df, end, parts):
    """Batches in an order of hashes: windows of a clip come out of order within and across batches."""
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("clip_id", "window_id"), F.lit(parts))
    for p in range(parts):
        df.where(part == p).orderBy(F.xxhash64("window_id")).coalesce(1).write.mode("append").parquet(path)
    for row in end.collect():
        spark.createDataFrame([row], end.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_distances(spark, rocks):
    df, end = live_windows(spark)
    stream = shuffled_stream(spark, df, end, 4).withColumnRenamed("mfcc_mean", "v")
    rows = drained(spark, S.live_distances(stream, late="30 seconds")).where("clip_id < 99").collect()
    got = {(r["clip_id"], r["window_id"]): r["mfcc_dist"] for r in rows}
    v = {(r["clip_id"], r["window_id"]): r["mfcc_mean"] for r in df.collect()}
    assert len(rows) == len(got) == 24
    for (c, w), dist in got.items():
        if w == 0 or v[c, w] is None or v[c, w - 1] is None:
            assert dist is None
        else:
            assert dist == pytest.approx(np.linalg.norm(np.subtract(v[c, w], v[c, w - 1])))


def test_idle_clips_start_anew(spark, rocks):
    """After a pause beyond ``idle`` a window has no predecessor, whether or not its timer came first."""
    at = [0, 1, 200, 201]
    rows = [(1, i, T0 + dt.timedelta(seconds=s), [float(i * i)]) for i, s in enumerate(at)]
    end = [(99, k, T0 + dt.timedelta(hours=1 + k), [0.0]) for k in range(2)]
    stream = replay(spark, spark.createDataFrame(rows + end, "clip_id int, window_id long, end_time timestamp, v array<double>"), 6, "end_time")
    got = {r["window_id"]: r["mfcc_dist"] for r in drained(spark, S.live_distances(stream)).where("clip_id = 1").collect()}
    assert got == {0: None, 1: 1.0, 2: None, 3: 5.0}


def test_live_scores_equal_the_batch(spark, rocks):
    df, end = live_windows(spark, clips=3, n=16, seed=2)
    base = spark.createDataFrame([(0, 1.5, 0.3), (1, 2.0, 0.5)], "clip_id int, mu double, sigma double")
    got = drained(spark, S.live_scores(shuffled_stream(spark, df, end, 5), base, late="30 seconds")).where("clip_id < 99")
    want = S.live_scores(df, base)
    cols = [c for c in want.columns if c != "raw_score"]
    assert got.count() == want.count() == 48 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.where("boundary_detected").count() > 0 and want.where("vocoder_score = 25 AND prosody_score = 25").count() >= 1


def test_jobs(spark, rocks):
    ev = b_jobs(spark, SF).where("job_id < 8")
    want = S.latest_progress(ev).select("job_id", "stage_index", "status")
    upd = drained(spark, S.live_jobs(replay(spark, ev, 3, "ts")), "update")
    last = upd.groupBy("job_id").agg(F.max_by(F.struct("stage_index", "status"), F.struct(F.expr("CAST(status IN ('completed','failed') AS INT)"), "updated_ms", "stage_index")).alias("r"))
    got = last.select("job_id", "r.stage_index", "r.status")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_terminal_status_wins(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 5, t, "completed"), (1, 2, t + dt.timedelta(seconds=9), "running"), (2, 1, t, "running"), (2, 2, t + dt.timedelta(seconds=1), "running")]
    d = spark.createDataFrame(rows, "job_id int, stage_index int, ts timestamp, status string")
    by = {r["job_id"]: (r["status"], r["progress_pct"]) for r in S.latest_progress(d).collect()}
    assert by == {1: ("completed", 100), 2: ("running", 50)}
    jobs = S.latest_progress(d)
    assert S.unexpired(jobs, "timestamp'2024-01-01 01:00:00'").count() == 2
    assert S.unexpired(jobs, "timestamp'2024-01-01 01:00:01'").count() == 1


def test_ingest_takes_each_content_once(spark, tmp_path):
    x = 0.1 * np.sin(np.arange(4000))
    for name, data in (("a.wav", wav_bytes(x)), ("b.wav", wav_bytes(x)), ("c.wav", wav_bytes(-x))):
        (tmp_path / name).write_bytes(data)
    got = drained(spark, S.ingest_recordings(spark, str(tmp_path), files_per_batch=1).select("path", "content_md5"))
    assert got.count() == 2 and got.select("content_md5").distinct().count() == 2


def test_ingest_over_three_batches_reads_kept_files_again(spark, tmp_path):
    """Duplicates within and across batches are dropped by digest; bytes come from the kept paths, odd names included."""
    x = 0.1 * np.sin(np.arange(4000))
    names = {"a [1].wav": wav_bytes(x), "b{2}.wav": wav_bytes(-x), "c.wav": wav_bytes(x), "d.wav": wav_bytes(-x), "e*.wav": wav_bytes(0.5 * x)}
    for name, data in names.items():
        (tmp_path / name).write_bytes(data)
    stream = S.ingest_recordings(spark, str(tmp_path), files_per_batch=2)
    assert "content" not in stream.columns
    got = []
    S.run_to_end(stream, lambda batch, _: got.extend(S.with_content(spark, batch).select("content", "content_md5").collect()), str(tmp_path.parent / "steps"))
    assert {bytes(r.content) for r in got} == set(names.values()) and len(got) == 3


def test_quality_metrics_are_observed(spark):
    from pyspark.sql import Observation

    obs = Observation("q")
    d = spark.createDataFrame([(1, None), (2, "empty")], "clip_id int, reject_reason string")
    S.with_quality_metrics(d, obs).collect()
    assert obs.get == {"rows_in": 2, "rejected": 1, "accepted": 1}
