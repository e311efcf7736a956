"""Clip profile queries (PRO-*, FRM-3..7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_pitch, b_samples, b_vec_embeddings, b_vec_windows, oracle, sql_round, table
from voxledger.catalog.indicators import SPECTRA, b_spectra
from voxledger.catalog.registry import query
from voxledger.catalog.spectra import CONTRAST, b_contrast
from voxledger.functions.ordered import SEG
from voxledger.operators import frames as FR
from voxledger.operators import prepare as P
from voxledger.operators import profiles as R


def b_frames(spark, sf) -> DataFrame:
    return P.frame_energy(P.frames_from_samples(b_samples(spark, sf), 4), 4)


_PITCH = f"""vo AS (SELECT *, abs(f0 - lag(f0) OVER (PARTITION BY clip_id ORDER BY frame_id)) AS d FROM b_pitch WHERE voiced),
ps AS (SELECT clip_id, count(*) AS n_voiced, avg(f0) AS mean_f0, quantile_cont(f0,0.5) AS med, min(f0) AS lo, max(f0) AS hi, coalesce(avg(d)/avg(f0)*100e0,0e0) AS jit FROM vo GROUP BY 1),
pc AS (SELECT clip_id, count(*) AS n_frames FROM b_pitch GROUP BY 1),
pp AS (SELECT pc.clip_id, n_frames, coalesce(n_voiced,0) AS n_voiced, coalesce(n_voiced,0) >= 40 AS available,
 CASE WHEN coalesce(n_voiced,0) < 40 THEN 'Insufficient voiced frames (' || coalesce(n_voiced,0) || ')' END AS reason,
 CASE WHEN n_voiced >= 40 THEN {sql_round('mean_f0', 2)} END AS mean_f0, CASE WHEN n_voiced >= 40 THEN {sql_round('med', 2)} END AS median_f0,
 CASE WHEN n_voiced >= 40 THEN lo END AS min_f0, CASE WHEN n_voiced >= 40 THEN hi END AS max_f0,
 CASE WHEN n_voiced >= 40 THEN {sql_round('12e0*log2(hi/lo)', 2)} END AS range_semitones, CASE WHEN n_voiced >= 40 THEN {sql_round('jit', 3)} END AS jitter_pct,
 CASE WHEN n_voiced >= 40 THEN {sql_round('n_voiced/n_frames::DOUBLE', 3)} END AS voiced_fraction FROM pc LEFT JOIN ps USING (clip_id))"""


def pitch_profiles(spark, sf) -> DataFrame:
    return R.pitch_profile(b_pitch(spark, sf), min_voiced=40)


@query("pro1_pitch_profile", oracle("SELECT * FROM pp", "b_pitch", ctes=_PITCH))
def _pro1(spark, sf):
    return pitch_profiles(spark, sf)


_POINTS = """pt AS (SELECT p.clip_id, j, p.frame_id, p.voiced, p.f0 FROM (SELECT clip_id, count(*) AS n, unnest(range(0,60)) AS j FROM b_pitch GROUP BY 1) c
 JOIN b_pitch p ON p.clip_id = c.clip_id AND p.frame_id = (j*(c.n-1))//59)"""


@query(
    "pro2_pitch_contour",
    oracle(f"SELECT clip_id, j, {sql_round('j/59e0', 4)} AS t, CASE WHEN voiced THEN f0 END AS f0 FROM pt", "b_pitch", ctes=_POINTS),
)
def _pro2(spark, sf):
    return R.pitch_contour(b_pitch(spark, sf))


def b_formants(spark, sf) -> DataFrame:
    """Price rows of an order's customer seen as formant frames."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("clip_id"), k.alias("frame_id"), F.lit(400.0 + 0.0).alias("base"),
        (F.lit(300.0) + k * 7 % 501).alias("f1"), (F.lit(1000.0) + k * 11 % 901).alias("f2"),
        (F.lit(2200.0) + k * 13 % 801).alias("f3"), (F.lit(3300.0) + k * 17 % 1201).alias("f4"),
    ).drop("base")


_FORMANT = f"""ff AS (SELECT o_custkey AS clip_id, 300e0+o_orderkey*7%501 AS f1, 1000e0+o_orderkey*11%901 AS f2, 2200e0+o_orderkey*13%801 AS f3, 3300e0+o_orderkey*17%1201 AS f4 FROM orders),
fp0 AS (SELECT clip_id, count(*) AS n_frames, quantile_cont(f1,0.5) AS m1, quantile_cont(f2,0.5) AS m2, quantile_cont(f3,0.5) AS m3, quantile_cont(f4,0.5) AS m4 FROM ff GROUP BY 1),
fp AS (SELECT clip_id, n_frames >= 5 AS available, CASE WHEN n_frames < 5 THEN 'Too few voiced frames for formant analysis (' || n_frames || ')' END AS reason, n_frames,
 CASE WHEN n_frames >= 5 THEN {sql_round('m1', 1)} END AS f1_hz, CASE WHEN n_frames >= 5 THEN {sql_round('m2', 1)} END AS f2_hz,
 CASE WHEN n_frames >= 5 THEN {sql_round('m3', 1)} END AS f3_hz, CASE WHEN n_frames >= 5 THEN {sql_round('m4', 1)} END AS f4_hz,
 CASE WHEN n_frames >= 5 THEN {sql_round('(m4-m1)/3e0', 1)} END AS formant_dispersion FROM fp0)"""


@query("pro3_formant_profile", oracle("SELECT * FROM fp", ctes=_FORMANT))
def _pro3(spark, sf):
    return R.formant_profile(b_formants(spark, sf))


_MASK = """mk AS (SELECT clip_id, frame_id, rms, rms > 0.15e0*max(rms) OVER (PARTITION BY clip_id) AS speech FROM b_frames),
sp AS (SELECT *, lag(frame_id) OVER (PARTITION BY clip_id ORDER BY frame_id) AS p FROM mk WHERE speech),
pa AS (SELECT clip_id, p+1 AS first_frame, frame_id-p-1 AS n_frames, (frame_id-p-1)*0.25e0 AS pause_sec FROM sp WHERE frame_id-p-1 > 0 AND (frame_id-p-1)*0.25e0 > 0.05)"""


@query("pro6_interior_pauses", oracle("SELECT * FROM pa", "b_frames", ctes=_MASK))
def _pro6(spark, sf):
    return R.interior_pauses(R.with_speech_mask(b_frames(spark, sf)), 0.25)


def rhythm_profiles(spark, sf) -> DataFrame:
    """Frames of 0.25 s; loud frames followed by quieter ones stand in for onsets."""
    fr = b_frames(spark, sf)
    masked = R.with_speech_mask(fr)
    on = fr.where("rms > 0.25").select("clip_id", "frame_id")
    dur = fr.groupBy("clip_id").agg((F.sum("n") * F.lit(0.0625)).alias("duration_sec"))
    return R.rhythm_profile(masked, on, dur, frame_sec=0.25, shortest_clip=4.0)


_RHYTHM = f"""rt AS (SELECT clip_id, sum(n)*0.0625e0 AS dur FROM b_frames GROUP BY 1),
rp AS (SELECT rt.clip_id, dur, coalesce(ss,0e0) AS ss, coalesce(no,0) AS no, coalesce(mp,0e0) AS mp FROM rt
 LEFT JOIN (SELECT clip_id, count(*) FILTER (speech)*0.25e0 AS ss FROM mk GROUP BY 1) USING (clip_id)
 LEFT JOIN (SELECT clip_id, count(*) AS no FROM b_frames WHERE rms > 0.25 GROUP BY 1) USING (clip_id)
 LEFT JOIN (SELECT clip_id, avg(pause_sec) AS mp FROM pa GROUP BY 1) USING (clip_id)),
rh AS (SELECT clip_id, dur >= 4 AS available, CASE WHEN dur < 4 THEN 'Audio too short for rhythm analysis' END AS reason,
 CASE WHEN dur >= 4 THEN {sql_round('no/dur', 3)} END AS onset_rate_per_sec, CASE WHEN dur >= 4 THEN CASE WHEN ss > 0.1 THEN {sql_round('no/ss', 3)} ELSE 0e0 END END AS articulation_rate_per_sec,
 CASE WHEN dur >= 4 THEN {sql_round('ss/dur', 3)} END AS speech_ratio, CASE WHEN dur >= 4 THEN {sql_round('mp', 3)} END AS mean_pause_sec FROM rp)"""


@query("pro4_5_rhythm_profile", oracle("SELECT * FROM rh", "b_frames", ctes=f"{_MASK}, {_RHYTHM}"))
def _pro4(spark, sf):
    return rhythm_profiles(spark, sf)


@query(
    "pro7_energy_curve",
    oracle(
        f"""SELECT clip_id, j, CASE WHEN top > 0 THEN {sql_round('rms/nullif(top,0)', 4)} ELSE rms END AS level FROM (SELECT *, max(rms) OVER (PARTITION BY clip_id) AS top FROM (
 SELECT p.clip_id, j, rms FROM (SELECT clip_id, count(*) AS n, unnest(range(0,60)) AS j FROM b_frames GROUP BY 1) c JOIN b_frames p ON p.clip_id=c.clip_id AND p.frame_id=(j*(c.n-1))//59))""",
        "b_frames",
    ),
)
def _pro7(spark, sf):
    return R.energy_curve(b_frames(spark, sf))


@query(
    "pro8_vector_stats",
    oracle(
        f"""SELECT clip_id, i-1 AS coeff, {sql_round('m', 4)} AS mean, {sql_round('s', 4)} AS var FROM (SELECT clip_id, i, avg(v[i]) AS m, var_pop(v[i]) AS s
 FROM b_vec_windows, (SELECT unnest(range(1,14)) AS i) GROUP BY 1,2)""",
        "b_vec_windows",
    ),
)
def _pro8(spark, sf):
    d = R.vector_stats(b_vec_windows(spark, sf), "v", 13)
    return d.select("clip_id", F.posexplode(F.arrays_zip("v_mean", "v_var")).alias("coeff", "r")).select(
        "clip_id", "coeff", F.col("r.v_mean").alias("mean"), F.col("r.v_var").alias("var")
    )


_SHAPE = """sh0 AS (SELECT *, sum(mag) OVER (PARTITION BY clip_id, frame_id) AS tot, sum(mag) OVER (PARTITION BY clip_id, frame_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS cum FROM sp),
sh1 AS (SELECT clip_id, frame_id, sum(mag*b*1000e0)/any_value(tot) AS centroid, min(b) FILTER (cum >= 0.85e0*tot)*1000e0 AS rolloff FROM sh0 GROUP BY 1,2),
sh AS (SELECT sh1.clip_id, sh1.frame_id, any_value(centroid) AS centroid, any_value(rolloff) AS rolloff, sqrt(sum(mag*power(b*1000e0-centroid,2))/any_value(tot)) AS bandwidth FROM sh1 JOIN sh0 USING (clip_id, frame_id) GROUP BY 1,2)"""


@query(
    "frm3_spectral_shape",
    oracle("SELECT clip_id, frame_id, round(centroid,3) AS centroid, round(bandwidth,3) AS bandwidth, rolloff FROM sh", "b_samples", ctes=f"{SPECTRA}, {_SHAPE}"),
)
def _frm3(spark, sf):
    d = FR.spectral_shape(b_spectra(spark, sf), 1000.0)
    return d.select("clip_id", "frame_id", F.round("centroid", 3).alias("centroid"), F.round("bandwidth", 3).alias("bandwidth"), "rolloff")


@query(
    "pro9_spectral_means",
    oracle(
        """SELECT clip_id, round(avg(centroid),1) AS spectral_centroid_mean, round(avg(bandwidth),1) AS spectral_bandwidth_mean,
 round(avg(rolloff),1) AS spectral_rolloff_mean, round(avg(contrast),3) AS spectral_contrast_mean FROM sh JOIN co USING (clip_id, frame_id) GROUP BY 1""",
        "b_samples", ctes=f"{SPECTRA}, {_SHAPE}, {CONTRAST}",
    ),
)
def _pro9(spark, sf):
    d = FR.spectral_shape(b_contrast(spark, sf), 1000.0)
    places = {"centroid": 1, "bandwidth": 1, "rolloff": 1, "contrast": 3}
    return R.spectral_means(d, {k: 9 for k in places}).select(
        "clip_id", *[F.round(f"spectral_{c}_mean", n).alias(f"spectral_{c}_mean") for c, n in places.items()]
    )


_ENERGY = f"""e0 AS (SELECT f.*, max(rms) OVER (PARTITION BY clip_id) AS top FROM b_frames f),
e1 AS (SELECT *, greatest(20e0*log10(greatest(1e-5,rms))-20e0*log10(greatest(1e-5,top+1e-9)), 20e0*log10(greatest(1e-5,top))-20e0*log10(greatest(1e-5,top+1e-9))-80e0) AS db FROM e0),
e2 AS (SELECT clip_id, avg(db) AS m, stddev_pop(db) AS s, quantile_cont(db,0.95)-quantile_cont(db,0.05) AS r FROM e1 GROUP BY 1),
e3 AS (SELECT clip_id, 20e0*log10((max(abs(x))+1e-9)/(sqrt(sum(x*x)/count(*))+1e-9)) AS c FROM b_samples GROUP BY 1),
ed AS (SELECT clip_id, {sql_round('m', 2)} AS rms_mean_db, {sql_round('s', 2)} AS rms_std_db, {sql_round('r', 2)} AS dynamic_range_db, {sql_round('c', 2)} AS crest_factor_db FROM e2 JOIN e3 USING (clip_id))"""


@query("pro10_energy_dynamics", oracle("SELECT * FROM ed", "b_frames", ctes=_ENERGY))
def _pro10(spark, sf):
    fr = b_frames(spark, sf)
    return R.energy_dynamics(fr).join(R.crest_factor(fr), "clip_id")


@query(
    "pro11_relative_variation",
    oracle(
        """SELECT clip_id, round(avg(rms),6) AS mean_rms, round(coalesce(avg(d)/avg(rms)*100e0,0e0),6) AS shimmer FROM
 (SELECT *, abs(rms-lag(rms) OVER (PARTITION BY clip_id ORDER BY frame_id)) AS d FROM b_frames) GROUP BY 1""",
        "b_frames",
    ),
)
def _pro11(spark, sf):
    d = R.relative_variation(b_frames(spark, sf), "rms", "frame_id", "shimmer")
    return d.select("clip_id", F.round("mean_rms", 6).alias("mean_rms"), F.round("shimmer", 6).alias("shimmer"))


@query(
    "pro12_environment_profile",
    oracle(
        """SELECT clip_id, round(avg(mean_db),3) AS noise_floor_db, round(avg(contrast),4) AS mean_spectral_contrast, round(avg(r95),3) AS rolloff_mean,
 round(stddev_pop(r95),3) AS rolloff_std FROM (SELECT clip_id, frame_id, any_value(contrast) AS contrast, min(b) FILTER (cum >= 0.95e0*tot)*1000e0 AS r95,
 avg(20e0*log10(greatest(mag,1e-5))) AS mean_db FROM sh0 JOIN co USING (clip_id, frame_id) GROUP BY 1,2) GROUP BY 1""",
        "b_samples", ctes=f"{SPECTRA}, {_SHAPE}, {CONTRAST}",
    ),
)
def _pro12(spark, sf):
    d = FR.spectral_shape(b_contrast(spark, sf), 1000.0, share=0.95).withColumns(
        {
            "rolloff95": F.col("rolloff"),
            "mean_db": F.expr("aggregate(transform(mag, m -> 20D * log10(greatest(m, 1e-5D))), 0D, (s, x) -> s + x) / size(mag)"),
        }
    )
    return R.environment_profile(d).select(
        "clip_id", F.round("noise_floor_db", 3).alias("noise_floor_db"), F.round("mean_spectral_contrast", 4).alias("mean_spectral_contrast"),
        F.round("rolloff_mean", 3).alias("rolloff_mean"), F.round("rolloff_std", 3).alias("rolloff_std"),
    )


@query(
    "pro13_embedding_pool",
    oracle(
        """SELECT clip_id, i-1 AS dim, round(m/sqrt(sum(m*m) OVER (PARTITION BY clip_id)),6) AS x FROM (SELECT clip_id, i, avg(v[i]) AS m
 FROM b_vec_embeddings, (SELECT unnest(range(1,65)) AS i) GROUP BY 1,2)""",
        "b_vec_embeddings",
    ),
)
def _pro13(spark, sf):
    d = R.pool_vectors(b_vec_embeddings(spark, sf), "v", 64)
    return d.select("clip_id", F.posexplode("embedding").alias("dim", "x")).select("clip_id", "dim", F.round("x", 6).alias("x"))


@query(
    "pro14_profile_defaults",
    oracle(
        """SELECT clip_id, CASE WHEN available THEN rms_mean_db ELSE -60e0 END AS rms_mean_db, CASE WHEN available THEN dynamic_range_db ELSE 0e0 END AS dynamic_range_db
 FROM ed JOIN rh USING (clip_id)""",
        "b_frames", ctes=f"{_ENERGY}, {_MASK}, {_RHYTHM}",
    ),
)
def _pro14(spark, sf):
    e, r = R.energy_dynamics(b_frames(spark, sf)), rhythm_profiles(spark, sf)
    d = r.where("available").join(e, "clip_id")
    return R.with_profile_defaults(r.select("clip_id").join(d.select("clip_id", "rms_mean_db", "dynamic_range_db"), "clip_id", "left"))


_ONSET = """oe AS (SELECT clip_id, idx AS frame_id, greatest(0e0, value - coalesce(lag(value) OVER (PARTITION BY clip_id ORDER BY idx), value)) AS o FROM b_events),
on1 AS (SELECT *, coalesce((o-min(o) OVER (PARTITION BY clip_id))/nullif(max(o) OVER (PARTITION BY clip_id)-min(o) OVER (PARTITION BY clip_id),0),0e0) AS v FROM oe),
on2 AS (SELECT *, max(v) OVER (PARTITION BY clip_id ORDER BY frame_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS top,
 avg(v) OVER (PARTITION BY clip_id ORDER BY frame_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS mean FROM on1),
on3 AS (SELECT *, frame_id - row_number() OVER (PARTITION BY clip_id ORDER BY frame_id) AS run FROM on2 WHERE v > 0 AND v = top AND v >= mean + 0.07e0)"""


@query(
    "frm6_onsets",
    oracle(
        "SELECT clip_id, frame_id FROM (SELECT *, min(frame_id) OVER (PARTITION BY clip_id, run) AS f0 FROM on3) WHERE (frame_id-f0) % 2 = 0",
        "b_events", ctes=_ONSET,
    ),
)
def _frm6(spark, sf):
    from voxledger.catalog.bindings import _numbered_events
    from voxledger.functions.ordered import ordered

    ev = ordered(_numbered_events(spark, sf), ["clip_id"], ["idx"], previous={"_p": "value"})
    env = ev.select("clip_id", F.col("idx").alias("frame_id"), F.expr("greatest(0D, value - coalesce(_p, value))").alias("o"), SEG)
    return FR.onsets(env, reach=32).select("clip_id", "frame_id")


@query(
    "frm7_score_with_baseline",
    oracle(
        f"""SELECT p.clip_id, greatest(0e0, least(100e0, {sql_round('coalesce(s, 50e0)', 1)})) AS model FROM pc p LEFT JOIN
 (SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey*13 % 2100)/20e0 - 2e0 END AS s FROM customer) USING (clip_id)""",
        "b_pitch", ctes=_PITCH,
    ),
)
def _frm7(spark, sf):
    clips = b_pitch(spark, sf).select("clip_id").distinct()
    # twentieths, so that halves of the last decimal occur, some beyond 0 to 100 and some null
    score = F.expr("CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 13 % 2100) / 20D - 2D END")
    scores = table(spark, sf, "customer").select(F.col("c_custkey").alias("clip_id"), score.alias("score"))
    return FR.score_with(clips, scores, ["clip_id"])


