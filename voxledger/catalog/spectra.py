"""Frame queries (FRM-2 to FRM-5) and the model hook, on frames of event samples and on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_samples, oracle, table
from voxledger.catalog.indicators import SPECTRA, b_spectra
from voxledger.catalog.registry import query
from voxledger.operators import profiles as R
from voxledger.operators import spectra as SP
from voxledger.operators.frames import predict_scores
from voxledger.operators.windows import overlapping_frames

SR, MELS, CEPSTRA = 16000, 6, 5
LOW, BANDS, QUANTILE = 1000.0, 3, 0.4
ORDER = 4
PITCH_SR, FMIN, FMAX = 1600, 107.0, 700.0
FREQS = np.arange(9) * 1000.0


def b_mfcc(spark, sf) -> DataFrame:
    return SP.mel_cepstra(b_spectra(spark, sf), SR, 16, MELS, CEPSTRA)


# mel scale: 200/3 Hz a step up to 1000 Hz, then 27 steps for a factor of 6.4
_MEL = f"""me AS (SELECT m, CASE WHEN q < 15e0 THEN q*200e0/3e0 ELSE 1000e0*exp(ln(6.4e0)/27e0*(q-15e0)) END AS hz FROM
 (SELECT m, m*(15e0+ln({SR}/2e0/1000e0)/(ln(6.4e0)/27e0))/{MELS + 1}e0 AS q FROM (SELECT unnest(range(0,{MELS + 2})) AS m))),
mt AS (SELECT l.m, b, greatest(0e0, least((b*1000e0-l.hz)/(c.hz-l.hz), (h.hz-b*1000e0)/(h.hz-c.hz)))*2e0/(h.hz-l.hz) AS w
 FROM me l JOIN me c ON c.m = l.m+1 JOIN me h ON h.m = l.m+2, (SELECT unnest(range(0,9)) AS b)),
md0 AS (SELECT clip_id, frame_id, m, 10e0*log10(greatest(1e-10, sum(mag*mag*w))) AS db FROM sp JOIN mt USING (b) GROUP BY 1,2,3),
md AS (SELECT clip_id, frame_id, m, greatest(db, max(db) OVER (PARTITION BY clip_id) - 80e0) AS db FROM md0),
mf AS (SELECT clip_id, frame_id, k, sum(db*cos(pi()*k*(2*m+1)/{2 * MELS}e0))*sqrt(2e0/{MELS}e0)*CASE k WHEN 0 THEN sqrt(0.5e0) ELSE 1e0 END AS c
 FROM md, (SELECT unnest(range(0,{CEPSTRA})) AS k) GROUP BY 1,2,3)"""


@query("frm2_mfcc", oracle("SELECT clip_id, frame_id, k AS coeff, round(c,5)+0e0 AS c FROM mf", "b_samples", ctes=f"{SPECTRA}, {_MEL}"))
def _frm2(spark, sf):
    d = b_mfcc(spark, sf).select("clip_id", "frame_id", F.posexplode("mfcc").alias("coeff", "c"))
    return d.select("clip_id", "frame_id", "coeff", (F.round("c", 5) + 0.0).alias("c"))


@query(
    "pro8_mfcc_stats",
    oracle("SELECT clip_id, k AS coeff, round(avg(c),4)+0e0 AS mean, round(var_pop(c),4) AS var FROM mf GROUP BY 1,2", "b_samples", ctes=f"{SPECTRA}, {_MEL}"),
)
def _pro8(spark, sf):
    d = R.vector_stats(b_mfcc(spark, sf), "mfcc", CEPSTRA).select("clip_id", F.posexplode(F.arrays_zip("mfcc_mean", "mfcc_var")).alias("coeff", "r"))
    return d.select("clip_id", "coeff", (F.col("r.mfcc_mean") + 0.0).alias("mean"), F.col("r.mfcc_var").alias("var"))


def b_contrast(spark, sf) -> DataFrame:
    return SP.band_contrast(b_spectra(spark, sf), FREQS, LOW, BANDS, QUANTILE)


# bands of bins 0, 0-1, 1-3 and 3-8; 1, 1, 2 and 2 bins count as strongest and weakest
CONTRAST = """cb AS (SELECT * FROM (VALUES (0,0,0,1),(1,0,1,1),(2,1,3,2),(3,3,8,2)) t(band, lo, hi, k)),
cr AS (SELECT clip_id, frame_id, band, k, mag, row_number() OVER (PARTITION BY clip_id, frame_id, band ORDER BY mag) AS up,
 row_number() OVER (PARTITION BY clip_id, frame_id, band ORDER BY mag DESC) AS down FROM sp JOIN cb ON b BETWEEN lo AND hi),
cl AS (SELECT clip_id, frame_id, band, 10e0*log10(greatest(1e-10, avg(mag) FILTER (down <= k))) AS p, 10e0*log10(greatest(1e-10, avg(mag) FILTER (up <= k))) AS v FROM cr GROUP BY 1,2,3),
ct1 AS (SELECT clip_id, frame_id, band, greatest(p, max(p) OVER (PARTITION BY clip_id)-80e0) AS peak, greatest(v, max(v) OVER (PARTITION BY clip_id)-80e0) AS valley FROM cl),
co AS (SELECT clip_id, frame_id, avg(peak-valley) AS contrast FROM ct1 GROUP BY 1,2)"""


@query(
    "frm3_contrast",
    oracle("SELECT clip_id, frame_id, band, round(peak,5)+0e0 AS peak, round(valley,5)+0e0 AS valley, round(contrast,5) AS contrast FROM ct1 JOIN co USING (clip_id, frame_id)", "b_samples", ctes=f"{SPECTRA}, {CONTRAST}"),
)
def _frm3c(spark, sf):
    d = b_contrast(spark, sf).select("clip_id", "frame_id", "contrast", F.posexplode(F.arrays_zip("peaks", "valleys")).alias("band", "r"))
    return d.select("clip_id", "frame_id", "band", (F.round("r.peaks", 5) + 0.0).alias("peak"), (F.round("r.valleys", 5) + 0.0).alias("valley"), F.round("contrast", 5).alias("contrast"))


_F32 = """f32 AS (SELECT clip_id, f AS frame_id, seq-f*16 AS j, x FROM
 (SELECT clip_id, unnest(range(0, greatest(0, (count(*)-32)//16+1))) AS f FROM b_samples GROUP BY clip_id)
 JOIN b_samples USING (clip_id) WHERE seq >= f*16 AND seq < f*16+32)"""
_YIN = f"""yd AS (SELECT a.clip_id, a.frame_id, t, sum((a.x-b.x)*(a.x-b.x)) AS d FROM f32 a JOIN f32 b USING (clip_id, frame_id), (SELECT unnest(range(0,17)) AS t)
 WHERE a.j < 16 AND b.j = a.j+t GROUP BY 1,2,3),
yc AS (SELECT *, CASE WHEN t = 0 THEN 1e0 ELSE d*t/greatest(1e-12, sum(CASE WHEN t > 0 THEN d ELSE 0e0 END) OVER (PARTITION BY clip_id, frame_id ORDER BY t)) END AS c FROM yd),
yn AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM yc WINDOW w AS (PARTITION BY clip_id, frame_id ORDER BY t)),
yr AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_id ORDER BY CASE WHEN c <= before AND c < after AND c < 0.1e0 THEN t ELSE 1000 END,
 c, t) AS r FROM yn WHERE t BETWEEN 2 AND 15),
yp AS (SELECT clip_id, frame_id, t AS lag, c AS dip, greatest(-1e0, least(1e0, CASE WHEN abs(before-2e0*c+after) > 1e-12 THEN 0.5e0*(before-after)/(before-2e0*c+after) ELSE 0e0 END)) AS shift FROM yr WHERE r = 1)"""


def b_frames32(spark, sf) -> DataFrame:
    return overlapping_frames(b_samples(spark, sf), 32, 16)


@query(
    "frm4_yin",
    oracle(
        f"""SELECT clip_id, frame_id, CAST(lag AS INTEGER) AS lag, round(dip,6) AS dip, round({PITCH_SR}e0/(lag+shift),4) AS f0,
 dip < 0.2e0 AND {PITCH_SR}e0/(lag+shift) BETWEEN {FMIN} AND {FMAX} AS voiced FROM yp""",
        "b_samples", ctes=f"{_F32}, {_YIN}",
    ),
)
def _frm4(spark, sf):
    d = SP.pitch_of(b_frames32(spark, sf), PITCH_SR, FMIN, FMAX)
    return d.select("clip_id", "frame_id", "lag", F.round("dip", 6).alias("dip"), F.round("f0", 4).alias("f0"), "voiced")


_LPC = f"""lx AS (SELECT clip_id, frame_id, j, (x-0.97e0*coalesce(lag(x) OVER (PARTITION BY clip_id, frame_id ORDER BY j), 0e0))*(0.5e0-0.5e0*cos(2e0*pi()*j/31e0)) AS x FROM f32),
lr0 AS (SELECT a.clip_id, a.frame_id, k, coalesce(sum(a.x*b.x), 0e0) AS r FROM lx a JOIN lx b USING (clip_id, frame_id), (SELECT unnest(range(0,{ORDER + 1})) AS k) WHERE b.j = a.j+k GROUP BY 1,2,3),
lr AS (SELECT clip_id, frame_id, max(r) FILTER (k=0) AS r0, max(r) FILTER (k=1) AS r1, max(r) FILTER (k=2) AS r2, max(r) FILTER (k=3) AS r3, max(r) FILTER (k=4) AS r4 FROM lr0 GROUP BY 1,2),
lv AS (SELECT clip_id, frame_id, 0 AS i, r0 AS e, 0e0 AS a1, 0e0 AS a2, 0e0 AS a3, 0e0 AS a4, r1, r2, r3, r4 FROM lr
 UNION ALL SELECT clip_id, frame_id, i+1, CASE WHEN e > 0 THEN e*(1e0-k*k) ELSE e END,
  CASE i WHEN 0 THEN k WHEN 1 THEN a1+k*a1 WHEN 2 THEN a1+k*a2 ELSE a1+k*a3 END,
  CASE i WHEN 0 THEN 0e0 WHEN 1 THEN k WHEN 2 THEN a2+k*a1 ELSE a2+k*a2 END,
  CASE i WHEN 2 THEN k WHEN 3 THEN a3+k*a1 ELSE 0e0 END, CASE i WHEN 3 THEN k ELSE 0e0 END, r1, r2, r3, r4
 FROM (SELECT *, CASE WHEN e > 0 THEN -(CASE i WHEN 0 THEN r1 WHEN 1 THEN r2+a1*r1 WHEN 2 THEN r3+a1*r2+a2*r1 ELSE r4+a1*r3+a2*r2+a3*r1 END)/e ELSE 0e0 END AS k FROM lv WHERE i < {ORDER}))"""


@query(
    "frm5_lpc",
    oracle(
        f"SELECT clip_id, frame_id, round(a1,5)+0e0 AS a1, round(a2,5)+0e0 AS a2, round(a3,5)+0e0 AS a3, round(a4,5)+0e0 AS a4 FROM lv WHERE i = {ORDER}",
        "b_samples", ctes=f"{_F32}, {_LPC}",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _frm5(spark, sf):
    d = SP.linear_prediction(b_frames32(spark, sf), 32, ORDER)
    return d.select("clip_id", "frame_id", *[(F.round(F.col("lpc")[k], 5) + 0.0).alias(f"a{k}") for k in range(1, ORDER + 1)])


def _linear_model():
    """A user's model: a weighted sum of the 64 numbers of a vector."""
    weights = (np.arange(64) * 7 % 11 - 5) / 10.0
    return lambda batch: batch @ weights


@query(
    "udf1_predict",
    oracle("SELECT vec_id, round(sum(CAST(embedding[i+1] AS DOUBLE)*((i*7 % 11)-5)/10e0),6)+0e0 AS score FROM embeddings, (SELECT unnest(range(0,64)) AS i) GROUP BY 1"),
)
def _udf1(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return d.select("vec_id", (F.round(predict_scores(d, "v", 64, _linear_model), 6) + 0.0).alias("score"))
