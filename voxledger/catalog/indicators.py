"""Indicator queries (IND-*), on frames bound from events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_pitch, b_samples, b_vec_windows, oracle, sql_round
from voxledger.catalog.registry import SQL, query
from voxledger.operators import indicators as I
from voxledger.operators import prepare as P
from voxledger.operators.frames import spectra_of
from voxledger.operators.windows import overlapping_frames

BAND = 5


def b_spectra(spark, sf) -> DataFrame:
    """Hann spectra of 16-sample frames; window = frame div 3, every third frame unvoiced."""
    fr = overlapping_frames(b_samples(spark, sf), 16, 8)
    d = spectra_of(fr, 16)
    return d.withColumn("window_id", F.floor(F.col("frame_id") / 3)).withColumn("voiced", F.col("frame_id") % 3 != 2)


SPECTRA = """s16 AS (SELECT clip_id, f AS frame_id, seq-f*8 AS j, x*(0.5e0-0.5e0*cos(2e0*pi()*(seq-f*8)/16e0)) AS x FROM
 (SELECT clip_id, unnest(range(0, greatest(0, (count(*)-16)//8+1))) AS f FROM b_samples GROUP BY clip_id)
 JOIN b_samples USING (clip_id) WHERE seq >= f*8 AND seq < f*8+16),
sp0 AS (SELECT clip_id, frame_id, b, sum(x*cos(2e0*pi()*b*j/16e0)) AS re, CASE WHEN b IN (0,8) THEN 0e0 ELSE -sum(x*sin(2e0*pi()*b*j/16e0)) END AS im
 FROM s16, (SELECT unnest(range(0,9)) AS b) GROUP BY 1,2,3),
sp AS (SELECT *, frame_id // 3 AS window_id, frame_id % 3 <> 2 AS voiced, sqrt(re*re+im*im) AS mag, atan2(im,re) AS phase FROM sp0)"""


@query(
    "frm1_spectra",
    oracle("SELECT clip_id, frame_id, b AS bin, round(mag,5) AS mag FROM sp", "b_samples", ctes=SPECTRA),
)
def _frm1(spark, sf):
    return b_spectra(spark, sf).select("clip_id", "frame_id", F.posexplode("mag").alias("bin", "m")).select(
        "clip_id", "frame_id", "bin", F.round("m", 5).alias("mag")
    )


_RIPPLE = """rp AS (SELECT clip_id, window_id, avg(abs(mag-prev))/(avg_mag+1e-6) AS hf_ripple FROM
 (SELECT *, lag(mag) OVER (PARTITION BY clip_id, frame_id ORDER BY b) AS prev, avg(mag) OVER (PARTITION BY clip_id, window_id) AS avg_mag FROM sp WHERE b >= 5)
 GROUP BY clip_id, window_id, avg_mag)"""
_HNR = """hn0 AS (SELECT clip_id, window_id, frame_id, any_value(voiced) AS voiced, max(mag) AS top, quantile_cont(mag,0.5) AS mid FROM sp GROUP BY 1,2,3),
hn AS (SELECT clip_id, window_id, CASE WHEN count(*) FILTER (voiced) > 1 THEN 10e0*log10(avg(top) FILTER (voiced)/(avg(mid) FILTER (voiced)+1e-8)) ELSE 20e0 END AS hnr_db FROM hn0 GROUP BY 1,2)"""
_PHASE = """ph AS (SELECT clip_id, window_id, var_pop(phase-prev) AS phase_var FROM
 (SELECT *, lag(phase) OVER (PARTITION BY clip_id, window_id, b ORDER BY frame_id) AS prev FROM sp) WHERE prev IS NOT NULL GROUP BY 1,2)"""


@query("ind1_hf_ripple", oracle("SELECT clip_id, window_id, round(hf_ripple,5) AS hf_ripple FROM rp", "b_samples", ctes=f"{SPECTRA}, {_RIPPLE}"))
def _ind1(spark, sf):
    return I.hf_ripple(I.band_stats(b_spectra(spark, sf), BAND)).select("clip_id", "window_id", F.round("hf_ripple", 5).alias("hf_ripple"))


@query("ind2_peak_to_median", oracle("SELECT clip_id, window_id, round(hnr_db,5) AS hnr_db FROM hn", "b_samples", ctes=f"{SPECTRA}, {_HNR}"))
def _ind2(spark, sf):
    return I.peak_to_median_db(I.band_stats(b_spectra(spark, sf), BAND), min_voiced=1).select("clip_id", "window_id", F.round("hnr_db", 5).alias("hnr_db"))


@query("ind3_phase_variance", oracle("SELECT clip_id, window_id, round(phase_var,5) AS phase_var FROM ph", "b_samples", ctes=f"{SPECTRA}, {_PHASE}"))
def _ind3(spark, sf):
    return I.phase_variance(b_spectra(spark, sf)).select("clip_id", "window_id", F.round("phase_var", 5).alias("phase_var"))


@query(
    "ind4_vocoder_score",
    oracle(
        f"""SELECT clip_id, window_id, CASE WHEN phase_var IS NULL THEN 25e0 ELSE greatest(2e0, least(98e0, {sql_round('raw', 1)})) END AS vocoder_score,
 concat_ws('; ', CASE WHEN rs > 55 THEN 'High-Frequency Ripple >6.5kHz' END, CASE WHEN hs > 55 THEN 'HNR Anomaly (Out of Natural Speech Range)' END,
 CASE WHEN ps > 55 AND phase_var IS NOT NULL THEN 'Phase Coherence Irregularity' END) AS checks FROM (SELECT *, 0.45e0*rs+0.30e0*hs+0.25e0*ps AS raw FROM (
 SELECT rp.clip_id, rp.window_id, phase_var, least(100e0, greatest(0e0, (hf_ripple-0.30e0)/0.55e0*100e0)) AS rs,
  CASE WHEN hnr_db < 8 OR hnr_db > 33 THEN 70e0 WHEN hnr_db < 12 OR hnr_db > 28 THEN 30e0 ELSE 5e0 END AS hs,
  CASE WHEN phase_var < 0.5 OR phase_var > 3.8 THEN 65e0 WHEN phase_var < 0.75 OR phase_var > 2.8 THEN 25e0 ELSE 5e0 END AS ps
 FROM rp JOIN hn USING (clip_id, window_id) LEFT JOIN ph USING (clip_id, window_id)))""",
        "b_samples", ctes=f"{SPECTRA}, {_RIPPLE}, {_HNR}, {_PHASE}",
    ),
)
def _ind4(spark, sf):
    sp = b_spectra(spark, sf)
    st = I.band_stats(sp, BAND)
    d = I.hf_ripple(st).join(I.peak_to_median_db(st, min_voiced=1), I.WINDOW).join(I.phase_variance(sp), I.WINDOW, "left")
    c = (F.col("hf_ripple"), F.col("hnr_db"), F.col("phase_var"))
    return d.select(*I.WINDOW, I.vocoder_score(*c).alias("vocoder_score"), F.concat_ws("; ", *I.vocoder_checks(*c)).alias("checks"))


def vec_frames(spark, sf) -> DataFrame:
    """Embedding windows seen as frames: 13 coefficients, centroid and RMS from the vector; window = frame div 8."""
    return b_vec_windows(spark, sf).select(
        "clip_id", F.col("window_id").alias("frame_id"), F.floor(F.col("window_id") / 8).alias("window_id"),
        F.col("v").alias("mfcc"), F.abs(F.col("v")[0]).alias("rms"), (F.col("v")[1] * 100.0).alias("centroid"), "seg",
    )


_VEC = """vf AS (SELECT clip_id, window_id AS frame_id, window_id // 8 AS window_id, v, abs(v[1]) AS rms, v[2]*100e0 AS centroid FROM b_vec_windows),
vq AS (SELECT *, quantile_cont(rms, 0.2) OVER (PARTITION BY clip_id, window_id) AS q FROM vf),
wm0 AS (SELECT clip_id, window_id, avg(centroid) AS centroid_mean, coalesce(avg(rms) FILTER (rms < q), avg(rms)) AS quiet_rms FROM vq GROUP BY 1,2),
wv AS (SELECT clip_id, window_id, i, avg(v[i]) AS m FROM vf, (SELECT unnest(range(1,14)) AS i) GROUP BY 1,2,3),
wd AS (SELECT a.clip_id, a.window_id, sqrt(sum((a.m-b.m)*(a.m-b.m))) AS mfcc_dist FROM wv a JOIN wv b ON a.clip_id=b.clip_id AND a.i=b.i AND a.window_id=b.window_id+1 GROUP BY 1,2),
tt AS (SELECT clip_id, count(*) AS t FROM vf GROUP BY 1),
ck AS (SELECT clip_id, unnest(range(0, greatest(1, t-12), 4)) AS c FROM tt),
cm AS (SELECT ck.clip_id, c // 4 AS k, i, avg(v[i]) AS m FROM ck JOIN vf ON vf.clip_id=ck.clip_id AND frame_id >= c AND frame_id < c+12, (SELECT unnest(range(1,14)) AS i) GROUP BY 1,2,3),
cd AS (SELECT a.clip_id, a.k, sqrt(sum((a.m-b.m)*(a.m-b.m))) AS d FROM cm a JOIN cm b ON a.clip_id=b.clip_id AND a.i=b.i AND a.k=b.k+1 GROUP BY 1,2),
bs AS (SELECT tt.clip_id, coalesce(avg(d), 30e0) AS mu, CASE WHEN count(d) >= 1 THEN stddev_pop(d)+1e-6 ELSE 10e0 END AS sigma FROM tt LEFT JOIN cd USING (clip_id) GROUP BY 1)"""


@query(
    "ind5_window_spectral",
    oracle(
        """SELECT wm0.clip_id, wm0.window_id, i-1 AS coeff, round(a.m,6) AS mfcc_mean, round(centroid_mean,6) AS centroid_mean, round(quiet_rms,6) AS quiet_rms
 FROM wm0 JOIN wv a ON a.clip_id=wm0.clip_id AND a.window_id=wm0.window_id""",
        "b_vec_windows", ctes=_VEC,
    ),
)
def _ind5(spark, sf):
    d = I.window_spectral(vec_frames(spark, sf))
    return d.select(
        "clip_id", "window_id", F.posexplode("mfcc_mean").alias("coeff", "m"), F.round("centroid_mean", 6).alias("centroid_mean"), F.round("quiet_rms", 6).alias("quiet_rms")
    ).withColumn("mfcc_mean", F.round("m", 6)).drop("m")


@query("ind6_mfcc_baseline", oracle("SELECT clip_id, round(mu,6) AS mu, round(sigma,6) AS sigma FROM bs", "b_vec_windows", ctes=_VEC))
def _ind6(spark, sf):
    d = I.mfcc_baseline(vec_frames(spark, sf), chunk=12, hop=4)
    return d.select("clip_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(
    "ind7_cross_window_distance",
    oracle(
        """SELECT wm0.clip_id, wm0.window_id, round(mfcc_dist,6) AS mfcc_dist, round(lag(quiet_rms) OVER (PARTITION BY wm0.clip_id ORDER BY wm0.window_id),6) AS prev_quiet_rms
 FROM wm0 LEFT JOIN wd ON wd.clip_id=wm0.clip_id AND wd.window_id=wm0.window_id""",
        "b_vec_windows", ctes=_VEC,
    ),
)
def _ind7(spark, sf):
    d = I.cross_window(I.window_spectral(vec_frames(spark, sf)))
    return d.select("clip_id", "window_id", F.round("mfcc_dist", 6).alias("mfcc_dist"), F.round("prev_quiet_rms", 6).alias("prev_quiet_rms"))


_SPECTRAL = """j0 AS (SELECT wm0.*, mfcc_dist, mu, sigma, mu+2.2e0*sigma AS thr, lag(quiet_rms) OVER (PARTITION BY wm0.clip_id ORDER BY wm0.window_id) AS pq
 FROM wm0 JOIN bs ON bs.clip_id=wm0.clip_id LEFT JOIN wd ON wd.clip_id=wm0.clip_id AND wd.window_id=wm0.window_id),
j1 AS (SELECT *, coalesce(mfcc_dist > thr, false) AS boundary_detected, CASE WHEN mfcc_dist IS NULL THEN 0e0 WHEN mfcc_dist > thr THEN least(100e0, 60e0+(mfcc_dist-thr)/(2e0*sigma)*40e0)
 WHEN mfcc_dist > mu THEN least(45e0, 10e0+(mfcc_dist-mu)/(thr-mu)*35e0) ELSE 5e0 END AS jump,
 coalesce(quiet_rms > 0.003 AND pq > 0.003 AND abs(quiet_rms-pq)/(pq+1e-8) > 0.65e0 AND mfcc_dist > thr*0.8e0, false) AS room_change FROM j0)"""


@query(
    "ind8_9_10_spectral_score",
    oracle(
        """SELECT clip_id, window_id, boundary_detected, room_change,
 round(greatest(2e0, least(98e0, CASE WHEN room_change THEN least(100e0, jump+25e0) ELSE jump END)),0) AS score0 FROM j1""",
        "b_vec_windows", ctes=f"{_VEC}, {_SPECTRAL}",
    ),
)
def _ind8(spark, sf):
    fr = vec_frames(spark, sf)
    d = I.spectral_indicator(I.window_spectral(fr), I.mfcc_baseline(fr, chunk=12, hop=4))
    # the raw score is compared to the unit; its one-decimal rounding is tested in tests/
    return d.select("clip_id", "window_id", "boundary_detected", "room_change", F.round("raw_score", 0).alias("score0"))


def windowed_pitch(spark, sf) -> DataFrame:
    return b_pitch(spark, sf).withColumn("window_id", F.floor(F.col("frame_id") / 24))


_PITCH = """pw AS (SELECT *, frame_id // 24 AS window_id FROM b_pitch),
vp AS (SELECT *, min(f0) OVER (PARTITION BY clip_id, window_id) AS lo, max(f0) OVER (PARTITION BY clip_id, window_id) AS hi, count(*) OVER (PARTITION BY clip_id, window_id) AS n,
 abs(f0 - lag(f0) OVER (PARTITION BY clip_id, window_id ORDER BY frame_id)) AS d FROM pw WHERE voiced),
hb AS (SELECT clip_id, window_id, n, coalesce(least(floor((f0-lo)/nullif(hi-lo,0)*least(15, n//2+1)), least(15, n//2+1)-1), 0) AS bin, count(*) AS c FROM vp GROUP BY 1,2,3,4),
eb AS (SELECT clip_id, window_id, max(n) AS n, -sum(c/n::DOUBLE*log2(c/n::DOUBLE))+0e0 AS entropy FROM hb GROUP BY 1,2),
jb AS (SELECT clip_id, window_id, avg(d)/greatest(avg(f0),1e0)*100e0 AS jitter, stddev_pop(f0) AS pitch_std FROM vp GROUP BY 1,2),
pi0 AS (SELECT w.clip_id, w.window_id, CASE WHEN n > 8 THEN entropy ELSE 2.8e0 END AS pitch_entropy, CASE WHEN n > 8 THEN jitter ELSE 1e0 END AS micro_jitter,
 CASE WHEN n > 8 THEN pitch_std ELSE 10e0 END AS pitch_std FROM (SELECT DISTINCT clip_id, window_id FROM pw) w LEFT JOIN eb USING (clip_id, window_id) LEFT JOIN jb USING (clip_id, window_id)),
cv AS (SELECT clip_id, frame_id // 6 AS window_id, stddev_pop(rms)/(avg(rms)+1e-8) AS energy_cv FROM b_frames GROUP BY 1,2)"""


@query("ind11_pitch_entropy", oracle("SELECT clip_id, window_id, n, round(entropy,6)+0e0 AS entropy FROM eb", "b_pitch", "b_frames", ctes=_PITCH))
def _ind11(spark, sf):
    d = I.binned_entropy(windowed_pitch(spark, sf).where("voiced"), I.WINDOW)
    return d.select("clip_id", "window_id", "n", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query(
    "ind12_micro_jitter",
    oracle("SELECT clip_id, window_id, round(jitter,6) AS jitter, round(pitch_std,6) AS pitch_std FROM jb", "b_pitch", "b_frames", ctes=_PITCH),
)
def _ind12(spark, sf):
    d = I.micro_jitter(windowed_pitch(spark, sf).where("voiced"), I.WINDOW)
    return d.select("clip_id", "window_id", F.round("jitter", 6).alias("jitter"), F.round("pitch_std", 6).alias("pitch_std"))


def window_frames(spark, sf) -> DataFrame:
    fr = P.frame_energy(P.frames_from_samples(b_samples(spark, sf), 4), 4)
    return fr.withColumn("window_id", F.floor(F.col("frame_id") / 6))


@query("ind13_energy_cv", oracle("SELECT clip_id, window_id, round(energy_cv,6) AS energy_cv FROM cv", "b_pitch", "b_frames", ctes=_PITCH))
def _ind13(spark, sf):
    return I.energy_cv(window_frames(spark, sf)).select("clip_id", "window_id", F.round("energy_cv", 6).alias("energy_cv"))


_PROSODY = """ps AS (SELECT pi0.clip_id, pi0.window_id, pitch_entropy AS e, micro_jitter AS j, energy_cv AS c,
 CASE WHEN pitch_entropy < 1.2 THEN 90e0 WHEN pitch_entropy < 1.8 THEN 70e0 WHEN pitch_entropy < 2.3 THEN 30e0 ELSE 10e0 END*0.50e0
 + CASE WHEN micro_jitter > 3.8 THEN 80e0 WHEN micro_jitter < 0.25 THEN 75e0 WHEN micro_jitter < 0.60 THEN 40e0 ELSE 10e0 END*0.35e0
 + CASE WHEN energy_cv < 0.25 THEN 65e0 WHEN energy_cv < 0.40 THEN 30e0 ELSE 10e0 END*0.15e0 AS raw FROM pi0 LEFT JOIN cv USING (clip_id, window_id))"""


@query(
    "ind14_16_17_prosody_score",
    oracle(
        f"""SELECT clip_id, window_id, CASE WHEN j IS NULL OR c IS NULL THEN 25e0 ELSE greatest(2e0, least(98e0, {sql_round('raw', 1)})) END AS prosody_score,
 concat_ws('; ', CASE WHEN e < 1.2 THEN 'Severely Constrained Pitch Entropy (Neural TTS Signature)' WHEN e < 1.8 THEN 'Low Pitch Entropy (Monotonic / Constrained Intonation)' END,
 CASE WHEN j > 3.8 THEN 'Elevated F0 Tracking Micro-Jitter (Neural Vocoder Phase Artefact)' WHEN j < 0.25 THEN 'Over-Smooth Pitch Contour (Synthetic Spline Interpolation)' END,
 CASE WHEN c < 0.25 THEN 'Flat Energy Envelope (Low Dynamic Variation)' END) AS checks FROM ps""",
        "b_pitch", "b_frames", ctes=f"{_PITCH}, {_PROSODY}",
    ),
)
def _ind14(spark, sf):
    d = I.pitch_indicator(windowed_pitch(spark, sf)).join(I.energy_cv(window_frames(spark, sf)), I.WINDOW, "left")
    c = (F.col("pitch_entropy"), F.col("micro_jitter"), F.col("energy_cv"))
    return d.select(*I.WINDOW, I.prosody_score(*c).alias("prosody_score"), F.concat_ws("; ", *I.prosody_checks(*c)).alias("checks"))


_SCORES = {name: SQL[query_name] for name, query_name in (("vo", "ind4_vocoder_score"), ("se", "ind8_9_10_spectral_score"), ("pr", "ind14_16_17_prosody_score"))}


@query(
    "ind17_fallback_scores",
    f"""SELECT clip_id, window_id, coalesce(vocoder_score, 25e0) AS vocoder_score, coalesce(score0, 15e0) AS spectral_score, coalesce(prosody_score, 25e0) AS prosody_score,
 coalesce(boundary_detected, false) AS boundary_detected
 FROM ({_SCORES['vo']}) vo FULL JOIN ({_SCORES['pr']}) pr USING (clip_id, window_id) FULL JOIN ({_SCORES['se']}) se USING (clip_id, window_id)""",
)
def _ind17(spark, sf):
    """All windows that any indicator saw; one that has no result of an indicator gets its fallback."""
    vocoder, prosody = _ind4(spark, sf).drop("checks"), _ind14(spark, sf).drop("checks")
    spectral = _ind8(spark, sf).select(*I.WINDOW, F.col("score0").alias("spectral_score"), "boundary_detected")
    d = vocoder.join(prosody, I.WINDOW, "full_outer").join(spectral, I.WINDOW, "full_outer")
    return I.fallback_scores(d.withColumn("boundary_detected", F.coalesce("boundary_detected", F.lit(False))))
