"""Stream queries as their batch twins (STR-*); the streams themselves are replayed in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_access, b_jobs, b_recordings, micros, oracle, table
from voxledger.catalog.indicators import BAND, b_spectra, vec_frames, window_frames, windowed_pitch
from voxledger.catalog.registry import SQL, query
from voxledger.operators import indicators as I
from voxledger.sources.recordings import reject_reason
from voxledger.streaming import streams as S

_SESSIONS = """sa AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY session_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM b_access),
sb AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM sa),
ss AS (SELECT session_id, min(ts) AS created_at, max(ts) AS last_accessed, max(ts) + INTERVAL 12 HOUR AS expires_at, count(*) AS n_access FROM sb GROUP BY session_id, no)"""


@query(
    "str1_sessions",
    oracle(
        "SELECT session_id, epoch_us(created_at) AS created_us, epoch_us(last_accessed) AS last_us, epoch_us(expires_at) AS expires_us, n_access FROM ss",
        "b_access", ctes=_SESSIONS,
    ),
)
def _str1(spark, sf):
    d = S.sessions(b_access(spark, sf), minutes=720)
    return d.select(
        "session_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_accessed").alias("last_us"),
        F.unix_micros("expires_at").alias("expires_us"), "n_access",
    )


_JOBS = """jr AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY (status IN ('completed','failed'))::INT DESC, sec DESC, stage_index DESC) AS rn FROM b_jobs),
jb AS (SELECT job_id, stage_index, status, sec, CASE WHEN status='completed' THEN 100 ELSE least(99, CAST(round((stage_index+1)*100e0/6) AS INTEGER)) END AS progress_pct FROM jr WHERE rn = 1)"""


@query("str2_latest_progress", oracle("SELECT job_id, stage_index, status, sec, progress_pct FROM jb", "b_jobs", ctes=_JOBS))
def _str2(spark, sf):
    return S.latest_progress(b_jobs(spark, sf)).select(
        "job_id", "stage_index", "status", F.unix_seconds("updated_at").alias("sec"), "progress_pct"
    )


@query(
    "str3_job_expiry",
    oracle("SELECT job_id, status FROM jb WHERE status NOT IN ('completed','failed') OR (SELECT max(sec) FROM b_jobs) - sec <= 3600", "b_jobs", ctes=_JOBS),
)
def _str3(spark, sf):
    jobs = S.latest_progress(b_jobs(spark, sf))
    now = b_jobs(spark, sf).agg(F.max("ts")).scalar()
    return S.unexpired(jobs, now).select("job_id", "status")


@query(
    "str4_live_scan",
    oracle(
        """SELECT clip_id, w*6*3600 AS start_sec, count(*) AS n_frames, round(avg(value),6) AS mean_rms, round(stddev_pop(value)/(avg(value)+1e-8),6) AS energy_cv FROM
 (SELECT user_id AS clip_id, value, unnest(range(epoch(ts)::BIGINT//21600-2, epoch(ts)::BIGINT//21600+1)) AS w FROM (SELECT user_id, value, date_trunc('second', ts) AS ts FROM events)) GROUP BY 1,2""",
    ),
)
def _str4(spark, sf):
    fr = table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), F.timestamp_micros(micros("ts")).alias("ts"), F.col("value").alias("rms"))
    d = S.live_scan(fr, length="18 hours", hop="6 hours")
    return d.select(
        "clip_id", F.unix_seconds("start_time").alias("start_sec"), "n_frames", F.round("mean_rms", 6).alias("mean_rms"),
        F.round("energy_cv", 6).alias("energy_cv"),
    )


@query(
    "str4_live_scores",
    f"""SELECT clip_id, window_id, coalesce(vocoder_score, 25e0) AS vocoder_score, score0, coalesce(prosody_score, 25e0) AS prosody_score, boundary_detected, room_change
 FROM ({SQL['ind8_9_10_spectral_score']}) se LEFT JOIN ({SQL['ind4_vocoder_score']}) vo USING (clip_id, window_id) LEFT JOIN ({SQL['ind14_16_17_prosody_score']}) pr USING (clip_id, window_id)""",
)
def _str4_scores(spark, sf):
    """All windows of the embeddings as live windows with a known baseline, as a batch."""
    frames, sp = vec_frames(spark, sf), b_spectra(spark, sf)
    bands = I.band_stats(sp, BAND)
    d = I.window_spectral(frames).withColumn("end_time", F.timestamp_seconds(F.col("window_id") + 1))
    for part in (
        I.hf_ripple(bands), I.peak_to_median_db(bands, min_voiced=1), I.phase_variance(sp),
        I.pitch_indicator(windowed_pitch(spark, sf)).drop("pitch_std"), I.energy_cv(window_frames(spark, sf)),
    ):
        d = d.join(part.drop("seg"), I.WINDOW, "left")
    scored = S.live_scores(d, I.mfcc_baseline(frames, chunk=12, hop=4))
    return scored.select("clip_id", "window_id", "vocoder_score", F.round("raw_score", 0).alias("score0"), "prosody_score", "boundary_detected", "room_change")


@query(
    "str5_ingest",
    oracle("SELECT md5(text) AS content_md5, min(path) AS path, any_value(length) AS length, count(*) AS copies FROM b_recordings GROUP BY 1", "b_recordings"),
)
def _str5(spark, sf):
    files = b_recordings(spark, sf).withColumn("modificationTime", F.lit("2026-01-31 12:00:00").cast("timestamp"))
    return S.ingested(files).drop("modificationTime")


@query("str6_active_counts", oracle("SELECT status, count(*) AS n FROM jb GROUP BY 1", "b_jobs", ctes=_JOBS))
def _str6(spark, sf):
    return S.active_counts(S.latest_progress(b_jobs(spark, sf)))


@query(
    "udf3_quality_metrics",
    oracle(
        """SELECT count(*) AS rows_in, count(r) AS rejected, count(*) - count(r) AS accepted FROM (SELECT CASE WHEN NOT regexp_matches(lower(path), '\\.(wav|mp3|flac|ogg|m4a)$') THEN 'x' WHEN length = 0 THEN 'x' WHEN length > 2000 THEN 'x' END AS r FROM b_recordings)""",
        "b_recordings",
    ),
)
def _udf3(spark, sf):
    """The counters a run reports, as a query of their own."""
    d = b_recordings(spark, sf).withColumn("reject_reason", reject_reason(max_bytes=2000))
    return S.with_quality_metrics(d, "ingest").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count("reject_reason").alias("rejected"),
        (F.count(F.lit(1)) - F.count("reject_reason")).alias("accepted"),
    )
