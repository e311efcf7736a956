"""Clip preparation queries (PRE-*, WIN-*), on samples bound from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_recordings, b_samples, b_stereo, oracle, sql_round
from voxledger.catalog.registry import query
from voxledger.functions.ordered import ordered, with_segments
from voxledger.operators import prepare as P
from voxledger.operators import windows as W

FRAME, TRIM, HOP, KEEP = 4, 8, 2, 8  # the fixture's frame, trim frame, trim hop and shortest trim


def frames(spark, sf) -> DataFrame:
    return P.frames_from_samples(b_samples(spark, sf), FRAME)


def energy(spark, sf) -> DataFrame:
    return P.frame_energy(frames(spark, sf), FRAME)


def gated(spark, sf) -> DataFrame:
    return P.gate(frames(spark, sf), FRAME, TRIM, HOP, KEEP)


_PROFILE = """lv AS (SELECT clip_id, sum(n) AS n_samples, count(*) FILTER (n=4) AS n_frames,
 20e0*log10(greatest(sqrt(sum(ss)/sum(n)),1e-10)) AS global_db, stddev_pop(rms_db) FILTER (n=4) AS std_db,
 quantile_cont(rms_db, 0.02) FILTER (n=4) AS noise_floor_db FROM b_frames GROUP BY 1),
pf AS (SELECT *, noise_floor_db + 6e0 AS threshold_db FROM lv),
ac AS (SELECT f.*, n_frames, threshold_db, std_db, global_db, noise_floor_db, n_samples, n = 4 AND rms_db >= threshold_db AS active FROM b_frames f JOIN pf USING (clip_id)),
ar AS (SELECT clip_id, count(*) FILTER (active) AS n_active, max(CASE WHEN frame_id = n_frames-1 AND active THEN 1 ELSE 0 END) AS last_active,
 any_value(n_frames) AS n_frames, any_value(std_db) AS std_db, any_value(global_db) AS global_db, any_value(threshold_db) AS threshold_db,
 any_value(noise_floor_db) AS noise_floor_db, any_value(n_samples) AS n_samples FROM ac GROUP BY 1)"""
_TRIM = """cl AS (SELECT clip_id, seq // 2 AS cell, sum(x*x) AS ss FROM b_samples GROUP BY 1,2),
ln AS (SELECT clip_id, count(*) AS len FROM b_samples GROUP BY 1),
fr AS (SELECT ln.clip_id, len, unnest(range(0, 1 + len // 2)) AS f FROM ln),
en AS (SELECT fr.clip_id, f, any_value(len) AS len, 20e0*log10(greatest(1e-5, sqrt(coalesce(sum(ss),0)/8e0))) AS db FROM fr
 LEFT JOIN cl ON cl.clip_id = fr.clip_id AND cell BETWEEN f-2 AND f+1 GROUP BY 1,2),
tp AS (SELECT *, max(db) OVER (PARTITION BY clip_id) AS top FROM en),
bd AS (SELECT clip_id, any_value(len) AS len, coalesce(min(f) FILTER (db > top-40e0)*2,0) AS t1_start, least(any_value(len), coalesce((max(f) FILTER (db > top-40e0)+1)*2,0)) AS t1_end,
 coalesce(min(f) FILTER (db > top-30e0)*2,0) AS t3_start, least(any_value(len), coalesce((max(f) FILTER (db > top-30e0)+1)*2,0)) AS t3_end FROM tp GROUP BY 1)"""
_TIER = """ti AS (SELECT ar.*, t1_start, t1_end, t3_start, t3_end, CASE WHEN n_frames=0 THEN 0 WHEN global_db < -60 THEN NULL
 WHEN std_db < 3 AND t1_end-t1_start >= 8 THEN 1 WHEN std_db < 3 THEN 0 WHEN n_active/n_frames::DOUBLE >= 0.20e0 THEN 2
 WHEN t3_end-t3_start >= 8 THEN 3 END AS tier FROM ar JOIN bd USING (clip_id))"""
_KEPT = """kp AS (SELECT s.clip_id, s.seq, s.x, tier, ti.n_frames FROM b_samples s JOIN ti USING (clip_id) LEFT JOIN ac a ON a.clip_id=s.clip_id AND a.frame_id = s.seq//4
 WHERE CASE tier WHEN 0 THEN TRUE WHEN 1 THEN s.seq >= t1_start AND s.seq < t1_end WHEN 3 THEN s.seq >= t3_start AND s.seq < t3_end
  WHEN 2 THEN CASE WHEN a.n = 4 THEN a.active ELSE last_active = 1 END ELSE FALSE END),
rs AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq) - 1 AS pos FROM kp),
lvl AS (SELECT clip_id, sqrt(sum(x*x)/count(*)) AS source_rms, count(*) AS speech_samples FROM kp GROUP BY 1),
nm AS (SELECT rs.clip_id, pos, seq, source_rms, speech_samples, CASE WHEN source_rms > 1e-8 THEN greatest(-1e0, least(1e0, x*(0.1e0/source_rms))) ELSE x END AS y FROM rs JOIN lvl USING (clip_id))"""


@query("pre1_downmix", oracle("SELECT clip_id, seq, round(avg(x),6) AS x FROM b_stereo GROUP BY 1,2", "b_stereo"))
def _pre1(spark, sf):
    return P.downmix(b_stereo(spark, sf)).select("clip_id", "seq", F.round("x", 6).alias("x"))


@query(
    "pre2_duration_cap",
    oracle(
        """SELECT clip_id, count(*) AS raw_samples, count(*) FILTER (seq < 50) AS kept_samples,
 round(sum(x) FILTER (seq < 50),6) AS kept_sum FROM b_samples GROUP BY 1""",
        "b_samples",
    ),
)
def _pre2(spark, sf):
    # raw length is taken before the cap
    s = b_samples(spark, sf)
    kept = P.cap_duration(s, max_seconds=5, sr=10).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("kept_samples"), F.round(F.sum("x"), 6).alias("kept_sum")
    )
    return s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("raw_samples")).join(kept, "clip_id")


@query(
    "pre3_4_frame_energy",
    oracle("SELECT clip_id, frame_id, n, round(rms,6) AS rms, round(rms_db,6) AS rms_db FROM b_frames WHERE n = 4", "b_frames"),
)
def _pre3(spark, sf):
    return energy(spark, sf).where("full").select(
        "clip_id", "frame_id", "n", F.round("rms", 6).alias("rms"), F.round("rms_db", 6).alias("rms_db")
    )


@query(
    "pre5_energy_profile",
    oracle(
        """SELECT clip_id, n_frames, n_active, round(global_db,6) AS global_db, round(std_db,6) AS std_db, round(noise_floor_db,6) AS noise_floor_db,
 round(threshold_db,6) AS threshold_db, round(n_active/n_frames::DOUBLE,6) AS active_ratio FROM ar""",
        "b_frames", ctes=_PROFILE,
    ),
)
def _pre5(spark, sf):
    fr = energy(spark, sf)
    d = P.with_activity(fr, P.energy_profile(fr)).where("frame_id = 0")
    r = {c: F.round(c, 6) for c in ("global_db", "std_db", "noise_floor_db", "threshold_db")}
    return d.withColumns(r).select(
        "clip_id", "n_frames", "n_active", *r, F.round(F.col("n_active") / F.col("n_frames"), 6).alias("active_ratio")
    )


@query(
    "pre6_gate_tier",
    oracle("SELECT clip_id, tier, CASE WHEN tier IS NULL THEN 'no_speech' END AS reject_reason FROM ti", "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}"),
)
def _pre6(spark, sf):
    return gated(spark, sf).groupBy("clip_id").agg(F.max("tier").alias("tier"), F.max("reject_reason").alias("reject_reason"))


@query(
    "pre7_active_frames",
    oracle(
        "SELECT clip_id, seq // 4 AS frame_id, count(*) AS n, round(sum(x),6) AS total FROM kp WHERE tier = 2 GROUP BY 1,2",
        "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}",
    ),
)
def _pre7(spark, sf):
    return gated(spark, sf).where("tier = 2").select(
        "clip_id", "frame_id", "n", F.round(F.aggregate("xs", F.lit(0.0), lambda s, x: s + x), 6).alias("total")
    )


@query(
    "pre8_edge_trim",
    oracle(
        "SELECT clip_id, t1_start, t1_end, t3_start, t3_end, tk_start, tk_end FROM bd JOIN bk USING (clip_id)", "b_samples",
        ctes=_TRIM + """, bk AS (SELECT clip_id, coalesce(min(f) FILTER (db > top-3e0)*2,0) AS tk_start,
 least(any_value(len), coalesce((max(f) FILTER (db > top-3e0)+1)*2,0)) AS tk_end FROM tp GROUP BY 1)""",
    ),
)
def _pre8(spark, sf):
    return P.edge_bounds(frames(spark, sf), {"t1": 40.0, "t3": 30.0, "tk": 3.0}, FRAME, TRIM, HOP)


@query(
    "pre9_resequence",
    oracle(
        "SELECT clip_id, pos, round(x,6) AS x FROM rs", "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}"
    ),
)
def _pre9(spark, sf):
    d = P.resequence(gated(spark, sf)).select("clip_id", F.col("pos").alias("first"), F.posexplode("xs").alias("i", "x"))
    return d.select("clip_id", (F.col("first") + F.col("i")).alias("pos"), F.round("x", 6).alias("x"))


@query(
    "pre10_normalise",
    oracle(
        """SELECT clip_id, count(*) AS n, round(any_value(source_rms),6) AS source_rms, round(sqrt(sum(y*y)/count(*)),6) AS out_rms,
 round(max(abs(y)),6) AS out_peak FROM nm GROUP BY 1""",
        "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}",
    ),
)
def _pre10(spark, sf):
    d = P.normalise_rms(P.resequence(gated(spark, sf))).select("clip_id", "source_rms", F.explode("xs").alias("y"))
    return d.groupBy("clip_id").agg(
        F.count("y").alias("n"), F.round(F.max("source_rms"), 6).alias("source_rms"),
        F.round(F.sqrt(F.avg(F.col("y") * F.col("y"))), 6).alias("out_rms"), F.round(F.max(F.abs(F.col("y"))), 6).alias("out_peak"),
    )


@query(
    "pre11_envelope",
    oracle(
        f"""SELECT clip_id, point, {sql_round('rel', 3)} AS level FROM (SELECT clip_id, point, CASE WHEN max(peak) OVER (PARTITION BY clip_id) > 0
 THEN peak/max(peak) OVER (PARTITION BY clip_id) ELSE peak END AS rel FROM (
 SELECT clip_id, pos // greatest(1, speech_samples // 10) AS point, max(abs(y)) AS peak FROM nm GROUP BY 1,2) WHERE point < 10)""",
        "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}",
    ),
)
def _pre11(spark, sf):
    return P.envelope(P.normalise_rms(P.resequence(gated(spark, sf))), points=10)


def _clip_states(spark, sf) -> DataFrame:
    d = P.normalise_rms(P.resequence(gated(spark, sf)))
    return d.groupBy("clip_id").agg(
        F.max(F.array_max(F.transform("xs", lambda x: F.abs(x)))).alias("peak"),
        *[F.max(c).alias(c) for c in ("tier", "reject_reason", "speech_samples", "source_rms", "n_frames", "n_active", "std_db", "noise_floor_db", "n_samples")],
    ).withColumn("error", F.when(F.col("clip_id") % 13 == 0, "undecodable"))


_STATES = """st AS (SELECT ti.clip_id, tier, n_frames, n_active, std_db, noise_floor_db, n_samples, coalesce(speech_samples, 0) AS sp, source_rms,
 CASE WHEN ti.clip_id % 13 = 0 THEN 'undecodable' WHEN tier IS NULL THEN 'no_speech' WHEN coalesce(speech_samples,0)/10e0 < 6.5e0 THEN 'too_short' END AS reason
 FROM ti LEFT JOIN lvl USING (clip_id))"""


@query(
    "pre12_reject_routing",
    oracle("SELECT clip_id, reason IS NULL AS accepted, reason FROM st", "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}, {_STATES}"),
)
def _pre12(spark, sf):
    good, bad = P.split_rejects(_clip_states(spark, sf), sr=10, min_seconds=6.5)
    return good.select("clip_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("clip_id", F.lit(False).alias("accepted"), "reason")
    )


@query(
    "pre13_step_log",
    oracle(
        """SELECT clip_id, concat_ws('; ', 'Stereo -> Mono downmix',
 CASE tier WHEN 1 THEN format('VAD tier1 (uniform-energy bypass): edge-trim applied. {:.2f}s retained (energy_std={:.1f}dB < 3.0dB, frame gating skipped)', sp/16000e0, std_db)
  WHEN 0 THEN format('VAD tier1 (uniform-energy bypass): full signal retained (energy_std={:.1f}dB)', std_db)
  WHEN 2 THEN format('VAD tier2 (frame-energy): {:d}/{:d} frames active ({:.0f}% retained, threshold: {:.1f}dB + 6.0dB)', n_active, n_frames, n_active/n_frames::DOUBLE*100e0, noise_floor_db)
  WHEN 3 THEN format('VAD tier3 (librosa fallback): edge-trim top_db=30 - {:.2f}s retained', sp/16000e0) END,
 format('RMS normalization (source RMS: {:.4f} -> target: 0.1)', source_rms)) AS steps FROM st WHERE tier IS NOT NULL""",
        "b_frames", ctes=f"{_PROFILE}, {_TRIM}, {_TIER}, {_KEPT}, {_STATES}",
    ),
)
def _pre13(spark, sf):
    d = _clip_states(spark, sf).where("tier IS NOT NULL").withColumn("channels", F.lit(2)).withColumn("raw_samples", F.col("n_samples"))
    return d.select("clip_id", F.array_join(P.step_log(max_seconds=120), "; ").alias("steps"))


@query(
    "win1_sliding_windows",
    oracle(
        """SELECT c.clip_id, w AS window_id, count(*) AS n, round(sqrt(sum(x*x)/count(*)),6) AS rms FROM
 (SELECT clip_id, unnest(range(0, greatest(1, (count(*)-24)//8+1))) AS w FROM b_samples GROUP BY clip_id) c
 JOIN b_samples s ON s.clip_id = c.clip_id AND seq >= w*8 AND seq < w*8+24 GROUP BY 1,2""",
        "b_samples",
    ),
)
def _win1(spark, sf):
    d = W.sliding_windows(b_samples(spark, sf), "seq", 24, 8)
    return d.groupBy("clip_id", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1))), 6).alias("rms")
    )


@query(
    "win2_embedding_windows",
    oracle(
        """SELECT clip_id, w AS window_id, w*2e0 AS start_sec, CASE WHEN dur <= 8 THEN dur ELSE least(w*2e0+6e0, dur) END AS end_sec FROM
 (SELECT clip_id, dur, unnest(range(0, CASE WHEN dur <= 8 THEN 1 ELSE CAST(ceil((dur-6e0)/2e0) AS BIGINT) + 1 END)) AS w FROM
  (SELECT clip_id, length/16e0 AS dur FROM b_recordings WHERE length > 0))
 WHERE dur <= 8 OR least(w*2e0+6e0, dur) - w*2e0 >= 0.5e0""",
        "b_recordings",
    ),
)
def _win2(spark, sf):
    clips = b_recordings(spark, sf).select("clip_id", (F.col("length") / F.lit(16.0)).alias("duration_sec"))
    return W.embedding_windows(clips).select("clip_id", "window_id", "start_sec", "end_sec")


_FRAMES16 = """SELECT clip_id, f AS frame_id, count(*) AS n, round(sum(x*(seq-f*4)),6) AS weighted FROM
 (SELECT clip_id, unnest(range(0, greatest(0, (count(*)-16)//4+1))) AS f FROM b_samples GROUP BY clip_id)
 JOIN b_samples USING (clip_id) WHERE seq >= f*4 AND seq < f*4+16 GROUP BY 1,2"""


def _weighted(d: DataFrame) -> DataFrame:
    s = F.aggregate(F.transform("xs", lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b)
    return d.select("clip_id", "frame_id", F.size("xs").cast("long").alias("n"), F.round(s, 6).alias("weighted"))


@query("win3_overlapping_frames", oracle(_FRAMES16, "b_samples"))
def _win3(spark, sf):
    return _weighted(W.overlapping_frames(b_samples(spark, sf), 16, 4))


def blocks(spark, sf, size: int = 32) -> DataFrame:
    """The samples as blocks of ``size``."""
    f = P.frames_from_samples(b_samples(spark, sf), FRAME).withColumn("pos", F.col("frame_id") * FRAME)
    return W.to_blocks(f, size)


@query("win3_frames_in_blocks", oracle(_FRAMES16, "b_samples"))
def _win3b(spark, sf):
    return _weighted(W.frames_in_blocks(blocks(spark, sf), 16, 4))


@query(
    "win1_windows_from_blocks",
    oracle(
        """SELECT c.clip_id, w AS window_id, count(*) AS n, round(sum(x*(seq-w*8)),6) AS weighted FROM
 (SELECT clip_id, unnest(range(0, greatest(1, (count(*)-24)//8+1))) AS w FROM b_samples GROUP BY clip_id) c
 JOIN b_samples s ON s.clip_id = c.clip_id AND seq >= w*8 AND seq < w*8+24 GROUP BY 1,2""",
        "b_samples",
    ),
)
def _win1b(spark, sf):
    b = with_segments(blocks(spark, sf, 8), ["clip_id"], "start", step=8)
    b = ordered(b, ["clip_id"], ["start"], totals={"n_clip": ("sum", F.size("xs"))})
    d = W.window_blocks(b, "n_clip", 24, 8)
    return _weighted(d.withColumnRenamed("window_id", "frame_id")).withColumnRenamed("frame_id", "window_id")


