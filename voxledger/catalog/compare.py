"""Pair queries (CMP-*): profiles side by side, fusion, contradictions, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.catalog.bindings import b_dims, b_pitch, oracle, sql_round, table
from voxledger.catalog.profiles import _FORMANT, _MASK, _PITCH, _RHYTHM, b_formants, pitch_profiles, rhythm_profiles
from voxledger.catalog.registry import query
from voxledger.functions import vectors as V
from voxledger.functions.numbers import ladder
from voxledger.operators import compare as C
from voxledger.operators import profiles as R


def neighbours(profiles: DataFrame, step: int = 1) -> DataFrame:
    """An explicit pair list: every clip with the clip ``step`` further on."""
    ids = profiles.select("clip_id")
    return ids.select(F.col("clip_id").alias("a_id"), (F.col("clip_id") + step).alias("b_id")).join(
        ids.withColumnRenamed("clip_id", "b_id"), "b_id", "left_semi"
    )


def clip_ids(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("clip_id")).distinct()


def vec_pairs(spark, sf) -> DataFrame:
    """Each embedding with the eight that follow it, joined on the id."""
    em = table(spark, sf, "embeddings")
    a = em.select(
        F.col("vec_id").alias("a_id"), F.col("embedding").alias("va"), F.col("label").alias("la"),
        F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 8)).alias("b_id"),
    )
    b = em.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vb"), F.col("label").alias("lb"))
    return a.join(b, "b_id")


VEC_PAIRS = """vp AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.embedding AS DOUBLE[]) AS va, CAST(b.embedding AS DOUBLE[]) AS vb, a.label = b.label AS same
 FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 8),
vc AS (SELECT *, list_dot_product(va,vb)/sqrt(list_dot_product(va,va)*list_dot_product(vb,vb)) AS cos FROM vp)"""


@query(
    "cmp2_cosine_pct",
    oracle("SELECT a_id, b_id, same, round(greatest(0e0, least(100e0, (cos+1)*50e0)),5) AS pct FROM vc", ctes=VEC_PAIRS),
)
def _cmp2(spark, sf):
    return vec_pairs(spark, sf).select("a_id", "b_id", F.expr("la = lb").alias("same"), F.round(V.cosine_pct("va", "vb"), 5).alias("pct"))


@query(
    "udf2_vector_columns",
    oracle(
        """SELECT a_id, b_id, round(list_dot_product(va,vb),5) AS dot, round(sqrt(list_dot_product(va,va)),5) AS norm_a,
 round(sqrt(list_sum(list_transform(list_zip(va,vb), lambda p: (p[1]-p[2])*(p[1]-p[2])))),5) AS euclid, round(va[1]/greatest(sqrt(list_dot_product(va,va)),1e-12),5) AS unit0 FROM vp""",
        ctes=VEC_PAIRS,
    ),
)
def _udf2(spark, sf):
    return vec_pairs(spark, sf).select(
        "a_id", "b_id", F.round(V.dot("va", "vb"), 5).alias("dot"), F.round(V.l2norm("va"), 5).alias("norm_a"),
        F.round(V.euclid("va", "vb"), 5).alias("euclid"), F.round(V.l2_normalise("va")[0], 5).alias("unit0"),
    )


def _lin(pairs: list[tuple[str, float, float]]) -> str:
    return "+".join(f"{w}e0*greatest(0e0, 1e0-abs(a.{f}-b.{f})/{t}e0)" for f, t, w in pairs)


_PITCH_LIN = _lin([("mean_f0", 80, 0.50), ("range_semitones", 12, 0.35), ("jitter_pct", 10, 0.15)])
_REASON = "CASE WHEN NOT (a.available AND b.available) THEN coalesce(a.reason, b.reason, '{}') END AS reason"


@query(
    "cmp1_3_20_pitch_score",
    oracle(
        f"""SELECT a_id, b_id, available, reason, CASE WHEN available THEN {sql_round('s*100e0', 1)} END AS score,
 CASE WHEN available THEN concat_ws(' ', CASE WHEN dm < 15 THEN 'Mean pitch is closely matched (' || format('{{:.1f}}', dm) || ' Hz apart).'
  WHEN dm < 40 THEN 'Mean pitch shows moderate divergence (' || format('{{:.1f}}', dm) || ' Hz), consistent with different recording conditions or emotional state.'
  ELSE 'Mean pitch diverges significantly (' || format('{{:.1f}}', dm) || ' Hz), suggesting different physiological vocal registers.' END,
 CASE WHEN dr < 3 THEN 'Pitch range (expressivity) is similar.' WHEN dr < 8 THEN 'Pitch range differs by ' || format('{{:.1f}}', dr) || ' semitones; may reflect different speaking styles.'
  ELSE 'Pitch range differs substantially (' || format('{{:.1f}}', dr) || ' semitones); this level of divergence is unlikely for the same speaker.' END) END AS text FROM (
 SELECT a.clip_id AS a_id, b.clip_id AS b_id, a.available AND b.available AS available, {_REASON.format('Pitch unavailable in one or both samples')},
 {_PITCH_LIN} AS s, abs(a.mean_f0-b.mean_f0) AS dm, abs(a.range_semitones-b.range_semitones) AS dr FROM pp a JOIN pp b ON b.clip_id = a.clip_id+1)""",
        "b_pitch", ctes=_PITCH,
    ),
)
def _cmp3(spark, sf):
    p = pitch_profiles(spark, sf)
    return C.pair_profiles(neighbours(clip_ids(spark, sf)), p).select(
        "a_id", "b_id", C.both_available().alias("available"),
        C.missing_reason("Pitch unavailable in one or both samples").alias("reason"),
        C.pitch_score().alias("score"), C.pitch_text().alias("text"),
    )


_FORMANT_LIN = _lin([("f1_hz", 200, 0.25), ("f2_hz", 300, 0.30), ("f3_hz", 350, 0.20), ("f4_hz", 400, 0.10), ("formant_dispersion", 300, 0.15)])


@query(
    "cmp4_20_formant_score",
    oracle(
        f"""SELECT a_id, b_id, reason, CASE WHEN available THEN {sql_round('s*100e0', 1)} END AS score,
 CASE WHEN available THEN concat_ws(' ', CASE WHEN d1 < 80 AND d2 < 120 THEN format('First and second formants are closely matched (F1 delta={{:.0f}} Hz, F2 delta={{:.0f}} Hz), consistent with similar vocal tract geometry.', d1, d2)
  WHEN d1 < 150 OR d2 < 200 THEN format('Formant structure shows partial agreement (F1 delta={{:.0f}} Hz, F2 delta={{:.0f}} Hz). Moderate divergence may reflect different phonetic context or recording conditions.', d1, d2)
  ELSE format('Formant profiles diverge substantially (F1 delta={{:.0f}} Hz, F2 delta={{:.0f}} Hz). This suggests different vocal tract anatomies, i.e. likely different speakers.', d1, d2) END,
 CASE WHEN dd > 150 THEN format('Formant dispersion differs by {{:.0f}} Hz, indicating a meaningful difference in estimated vocal tract length.', dd) END) END AS text FROM (
 SELECT a.clip_id AS a_id, b.clip_id AS b_id, a.available AND b.available AS available, {_REASON.format('Formant analysis unavailable in one or both samples')}, {_FORMANT_LIN} AS s,
 abs(a.f1_hz-b.f1_hz) AS d1, abs(a.f2_hz-b.f2_hz) AS d2, abs(a.formant_dispersion-b.formant_dispersion) AS dd FROM fp a JOIN fp b ON b.clip_id = a.clip_id+1)""",
        ctes=_FORMANT,
    ),
)
def _cmp4(spark, sf):
    p = R.formant_profile(b_formants(spark, sf))
    return C.pair_profiles(neighbours(b_formants(spark, sf).select("clip_id").distinct()), p).select(
        "a_id", "b_id", C.missing_reason("Formant analysis unavailable in one or both samples").alias("reason"),
        C.formant_score().alias("score"), C.formant_text().alias("text"),
    )


_RHYTHM_LIN = _lin([("onset_rate_per_sec", 5, 0.35), ("articulation_rate_per_sec", 6, 0.35), ("speech_ratio", 0.5, 0.15), ("mean_pause_sec", 1, 0.15)]).replace("0.5e0)", "0.5e0)")


@query(
    "cmp5_20_rhythm_score",
    oracle(
        f"""SELECT a_id, b_id, reason, CASE WHEN available THEN {sql_round('s*100e0', 1)} END AS score,
 CASE WHEN available THEN concat_ws(' ', CASE WHEN d < 1 THEN format('Syllable onset rates are closely matched ({{:.2f}} vs {{:.2f}} onsets/sec).', r1, r2)
  WHEN d < 3 THEN format('Moderate difference in onset rate ({{:.2f}} vs {{:.2f}} onsets/sec). Could reflect different speaking styles or emotional states.', r1, r2)
  ELSE format('Substantial onset rate divergence ({{:.2f}} vs {{:.2f}} onsets/sec), suggesting different speaking tempos.', r1, r2) END,
 CASE WHEN abs(a1-a2) > 2 THEN format('Articulation rates differ meaningfully ({{:.2f}} vs {{:.2f}} syllables/sec of active speech).', a1, a2) END) END AS text FROM (
 SELECT a.clip_id AS a_id, b.clip_id AS b_id, a.available AND b.available AS available, {_REASON.format('Rhythm analysis unavailable')}, {_RHYTHM_LIN} AS s,
 a.onset_rate_per_sec AS r1, b.onset_rate_per_sec AS r2, a.articulation_rate_per_sec AS a1, b.articulation_rate_per_sec AS a2, abs(a.onset_rate_per_sec-b.onset_rate_per_sec) AS d FROM rh a JOIN rh b ON b.clip_id = a.clip_id+1)""",
        "b_frames", ctes=f"{_MASK}, {_RHYTHM}",
    ),
)
def _cmp5(spark, sf):
    p = rhythm_profiles(spark, sf)
    return C.pair_profiles(neighbours(clip_ids(spark, sf)), p).select(
        "a_id", "b_id", C.missing_reason("Rhythm analysis unavailable").alias("reason"), C.rhythm_score().alias("score"), C.rhythm_text().alias("text"),
    )


def spectral_profiles(spark, sf) -> DataFrame:
    """Embeddings seen as spectral profiles, one per vector."""
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        k.alias("clip_id"),
        F.when(k % 50 == 7, F.array_repeat(F.lit(0.0), 13)).otherwise(
            F.transform(F.slice("embedding", 1, 13), lambda v: F.rint(v.cast("double") * 4096.0) / 1024.0)
        ).alias("mfcc_mean"),
        (F.lit(1000.0) + k * 37 % 2501).alias("spectral_centroid_mean"),
        (F.lit(1500.0) + k * 41 % 1003).alias("spectral_bandwidth_mean"),
        (F.lit(3000.0) + k * 53 % 3001).alias("spectral_rolloff_mean"),
        (F.lit(90.0) + k * 11 % 121).alias("mean_pitch"),
        (F.lit(-40.0) + k * 3 % 31).alias("rms_mean_db"),
        (F.lit(10.0) + k * 7 % 23).alias("dynamic_range_db"),
        (F.lit(-60.0) + k * 5 % 37).alias("noise_floor_db"),
        (F.lit(15.0) + (k * 9 % 64) / F.lit(8.0)).alias("mean_spectral_contrast"),
        (F.lit(4000.0) + k * 61 % 2203).alias("rolloff_mean"),
    )


_SPEC = """em AS (SELECT vec_id AS clip_id, CASE WHEN vec_id % 50 = 7 THEN list_transform(range(13), lambda z: 0e0) ELSE list_transform(embedding[1:13], lambda v: round_even(CAST(v AS DOUBLE)*4096e0,0)/1024e0) END AS m,
 1000e0+vec_id*37%2501 AS ce, 1500e0+vec_id*41%1003 AS bw, 3000e0+vec_id*53%3001 AS ro, 90e0+vec_id*11%121 AS mp, -40e0+vec_id*3%31 AS rd, 10e0+vec_id*7%23 AS dr,
 -60e0+vec_id*5%37 AS nf, 15e0+(vec_id*9%64)/8e0 AS sc, 4000e0+vec_id*61%2203 AS rm FROM embeddings),
pr AS (SELECT a.clip_id AS a_id, b.clip_id AS b_id, a.m AS m1, b.m AS m2, abs(a.ce-b.ce) AS dce, abs(a.bw-b.bw) AS dbw, abs(a.ro-b.ro) AS dro, abs(a.mp-b.mp) AS dmp, abs(a.rd-b.rd) AS drd, abs(a.dr-b.dr) AS ddr,
 abs(a.nf-b.nf) AS dnf, abs(a.sc-b.sc) AS dsc, abs(a.rm-b.rm) AS drm FROM em a JOIN em b ON b.clip_id = a.clip_id+1),
sc0 AS (SELECT *, sqrt(list_dot_product(m1,m1))*sqrt(list_dot_product(m2,m2)) AS nn FROM pr),
sc1 AS (SELECT *, (CASE WHEN nn > 0 THEN (list_dot_product(m1,m2)/nullif(nn,0)+1e0)/2e0 ELSE 0.5e0 END*0.50e0 + (0.20e0*greatest(0e0,1e0-dce/2000e0)+0.15e0*greatest(0e0,1e0-dro/3000e0)+0.15e0*greatest(0e0,1e0-dmp/80e0)))*100e0 AS raw FROM sc0)"""


@query("cmp6_spectral_score", oracle(f"SELECT a_id, b_id, {sql_round('raw', 1)} AS score FROM sc1", ctes=_SPEC))
def _cmp6(spark, sf):
    p = spectral_profiles(spark, sf)
    return C.pair_profiles(neighbours(p), p).select("a_id", "b_id", C.spectral_score().alias("score"))


@query(
    "cmp7_mfcc_deltas",
    oracle(
        f"""SELECT a_id, b_id, CAST(i AS INTEGER) AS coeff, {sql_round('x', 3)} AS val_1, {sql_round('y', 3)} AS val_2, delta, max_delta,
 CASE WHEN least(delta/greatest(max_delta,1e0),1e0) >= 0.75 THEN '#f87171' WHEN least(delta/greatest(max_delta,1e0),1e0) >= 0.5 THEN '#facc15'
 WHEN least(delta/greatest(max_delta,1e0),1e0) >= 0.25 THEN '#a3e635' ELSE '#00ff88' END AS band FROM (
 SELECT *, max(delta) OVER (PARTITION BY a_id) AS max_delta FROM (SELECT a_id, b_id, i, m1[i] AS x, m2[i] AS y, {sql_round('abs(m1[i]-m2[i])', 3)} AS delta FROM pr, (SELECT unnest(range(1,14)) AS i)))""",
        ctes=_SPEC,
    ),
)
def _cmp7(spark, sf):
    p = spectral_profiles(spark, sf)
    return C.mfcc_deltas(C.pair_profiles(neighbours(p), p))


@query(
    "cmp7_20_spectral_deltas",
    oracle(
        f"""SELECT a_id, b_id, dce AS delta_centroid_hz, dbw AS delta_bandwidth_hz, dro AS delta_rolloff_hz, drd AS delta_rms_db, ddr AS delta_dynamic_range_db,
 CASE WHEN sc >= 75 THEN 'Spectral and MFCC fingerprints are closely matched, suggesting similar vocal timbre and resonance characteristics.'
 WHEN sc >= 50 THEN 'Moderate spectral divergence (MFCC mean delta=' || t || '; centroid delta=' || format('{{:.0f}}', dce) || ' Hz). Could reflect different microphone responses or speaking styles.'
 ELSE 'Spectral profiles differ substantially (MFCC mean delta=' || t || '; centroid delta=' || format('{{:.0f}}', dce) || ' Hz), indicating different acoustic characteristics between samples.' END AS text FROM (
 SELECT *, {sql_round('raw', 1)} AS sc, format('{{:.2f}}', {sql_round('md', 2)}) AS t FROM (SELECT *, list_sum(list_transform(list_zip(m1,m2), lambda p: {sql_round('abs(p[1]-p[2])', 3)}))/13e0 AS md FROM sc1))""",
        ctes=_SPEC,
    ),
)
def _cmp7t(spark, sf):
    p = spectral_profiles(spark, sf)
    d = C.pair_profiles(neighbours(p), p).withColumn("score", C.spectral_score())
    return C.with_spectral_text(d).select("a_id", "b_id", *C.spectral_deltas(), "text")


@query(
    "cmp8_environment_score",
    oracle(
        """SELECT a_id, b_id, round(greatest(0e0, 100e0-(least(40e0,dnf/20e0*40e0)+least(30e0,dsc/5e0*30e0)+least(30e0,drm/2000e0*30e0))),6) AS score FROM pr""",
        ctes=_SPEC,
    ),
)
def _cmp8(spark, sf):
    p = spectral_profiles(spark, sf)
    return C.pair_profiles(neighbours(p), p).select("a_id", "b_id", F.round(C.environment_score(), 6).alias("score"))


_W = K.DIMENSION_WEIGHTS
_NUM = "+".join(f"coalesce({c}*{w}e0,0e0)" for c, w in _W.items())
_DEN = "+".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w}e0 END" for c, w in _W.items())
_FUSED = f"""n0 AS (SELECT *, {sql_round('coalesce(first_neural*0.6e0+second_neural*0.4e0, second_neural)', 1)} AS neural_identity, greatest(risk1,risk2) AS max_risk, no_speech_1 OR no_speech_2 AS no_speech FROM b_dims),
n1 AS (SELECT *, CASE WHEN max_risk > 60 THEN (max_risk-60e0)/40e0*30e0 ELSE 0e0 END AS penalty, ({_NUM})/({_DEN}) AS base FROM n0),
n2 AS (SELECT *, CASE WHEN no_speech THEN 0e0 ELSE {sql_round('greatest(0e0, base-penalty)', 1)} END AS similarity FROM n1),
fu AS (SELECT *, CASE WHEN no_speech THEN 'Cannot Compare' WHEN similarity >= 85 THEN 'Very Likely Same Speaker' WHEN similarity >= 75 THEN 'Likely Same Speaker' WHEN similarity >= 60 THEN 'Inconclusive'
  WHEN similarity >= 45 THEN 'Likely Different Speaker' ELSE 'Very Likely Different Speaker' END AS verdict,
 CASE WHEN no_speech THEN 'neutral' WHEN similarity >= 85 THEN 'green' WHEN similarity >= 75 THEN 'lime' WHEN similarity >= 60 THEN 'yellow' WHEN similarity >= 45 THEN 'orange' ELSE 'red' END AS colour,
 CASE WHEN no_speech THEN 'NONE' WHEN first_neural IS NOT NULL AND similarity >= 65 AND max_risk < 40 THEN 'HIGH' WHEN similarity >= 45 AND max_risk < 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM n2)"""


@query("cmp9_neural_composite", oracle("SELECT pair_id, neural_identity FROM n0", "b_dims", ctes=_FUSED))
def _cmp9(spark, sf):
    return b_dims(spark, sf).select("pair_id", C.neural_composite("first_neural", "second_neural").alias("neural_identity"))


@query(
    "cmp10_11_fusion",
    oracle("SELECT pair_id, round(base,6) AS base, round(penalty,6) AS penalty, similarity FROM fu", "b_dims", ctes=_FUSED),
)
def _cmp10(spark, sf):
    return C.fuse(b_dims(spark, sf)).select("pair_id", F.round("base", 6).alias("base"), F.round("penalty", 6).alias("penalty"), "similarity")


@query(
    "cmp12_13_16_verdict",
    oracle(
        """SELECT pair_id, similarity, verdict, colour, confidence, no_speech, CASE WHEN no_speech_1 AND no_speech_2 THEN 'Target Sample, Comparison Sample'
 WHEN no_speech_1 THEN 'Target Sample' WHEN no_speech_2 THEN 'Comparison Sample' ELSE '' END AS muted FROM fu""",
        "b_dims", ctes=_FUSED,
    ),
)
def _cmp12(spark, sf):
    return C.fuse(b_dims(spark, sf)).select(
        "pair_id", "similarity", "verdict", "colour", "confidence", "no_speech", F.array_join("no_speech_files", ", ").alias("muted")
    )


@query(
    "cmp12_score_ladder_page",
    oracle(
        """SELECT pair_id, CASE WHEN similarity >= 75 THEN 'emerald' WHEN similarity >= 55 THEN 'lime' WHEN similarity >= 40 THEN 'yellow' WHEN similarity >= 25 THEN 'orange' ELSE 'red' END AS page FROM fu""",
        "b_dims", ctes=_FUSED,
    ),
)
def _cmp12b(spark, sf):
    steps = [(75.0, "emerald"), (55.0, "lime"), (40.0, "yellow"), (25.0, "orange")]
    return C.fuse(b_dims(spark, sf)).select("pair_id", ladder("similarity", steps, "red").alias("page"))


def _case(key: str, names: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_DIMS = ", ".join(f"'{k}'" for k in K.DIMENSION_ORDER)
_COLS = ", ".join(K.DIMENSION_ORDER)
_CONTRA = f"""un AS (SELECT pair_id, unnest([{_DIMS}]) AS k, unnest([{_COLS}]) AS x, unnest(range(6)) AS i FROM fu WHERE NOT no_speech),
ct AS (SELECT a.pair_id, CASE WHEN a.x>b.x THEN a.k ELSE b.k END AS high, CASE WHEN a.x>b.x THEN b.k ELSE a.k END AS low, greatest(a.x,b.x) AS sh, least(a.x,b.x) AS sl, abs(a.x-b.x) AS d
 FROM un a JOIN un b ON a.pair_id=b.pair_id AND a.i<b.i WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND abs(a.x-b.x) >= 25)"""


@query(
    "cmp14_15_contradictions",
    oracle(
        f"""SELECT pair_id, 'dimension_conflict' AS type, high AS dim_high, low AS dim_low, sh AS score_high, sl AS score_low, {sql_round('d', 1)} AS delta,
 {_case('high', K.DIMENSION_PHRASES)} || ' shows high agreement (' || format('{{:.1f}}', sh) || '%) while ' || {_case('low', K.DIMENSION_PHRASES)} || ' shows low agreement (' || format('{{:.1f}}', sl) ||
 '%). This divergence is forensically significant and warrants closer examination of each dimension independently.' AS message FROM ct
 UNION ALL SELECT pair_id, 'synthetic_identity_conflict', 'neural_identity', 'deepfake_risk', neural_identity, max_risk, {sql_round('abs(neural_identity-max_risk)', 1)},
 'Neural identity score is high (' || format('{{:.1f}}', neural_identity) || '%) but deepfake risk is also elevated (' || format('{{:.1f}}', max_risk) ||
 '%). Match confidence is reduced — one or both samples may be a voice clone targeting the reference speaker.' FROM fu WHERE NOT no_speech AND neural_identity >= 65 AND max_risk >= 50""",
        "b_dims", ctes=f"{_FUSED}, {_CONTRA}",
    ),
)
def _cmp14(spark, sf):
    return C.contradictions(C.fuse(b_dims(spark, sf)))


@query(
    "cmp17_dimension_rows",
    oracle(
        f"""SELECT pair_id, {_case('k', K.RADAR_LABELS)} AS dimension, k AS key, x AS score, CAST(CASE k {' '.join(f"WHEN '{k}' THEN {round(w * 100)}" for k, w in _W.items())} END AS INTEGER) AS weight_pct, x IS NOT NULL AS available
 FROM (SELECT pair_id, unnest([{_DIMS}]) AS k, unnest([{_COLS}]) AS x FROM fu)""",
        "b_dims", ctes=_FUSED,
    ),
)
def _cmp17(spark, sf):
    return C.dimension_rows(C.fuse(b_dims(spark, sf)))


@query(
    "cmp18_telemetry",
    oracle(
        f"""SELECT pair_id, {_case('k', K.TELEMETRY_LABELS)} AS dimension, k AS key, x AS score, x IS NOT NULL AS available, CASE WHEN k = 'pitch' THEN 100e0+pitch END AS val_1, CASE WHEN k = 'pitch' THEN 150e0 END AS val_2,
 CASE WHEN k = 'pitch' THEN 'Hz' END AS unit, CASE WHEN k = 'pitch' THEN 'Mean F0 delta' END AS delta_label, CASE WHEN k = 'pitch' THEN abs(50e0-pitch) END AS delta,
 CASE WHEN k = 'neural_identity' THEN 'Composite WavLM + ECAPA-TDNN voice embedding similarity.' WHEN k = 'energy' THEN 'Signal environment and RMS loudness profile consistency.' END AS interpretation,
 CASE WHEN x IS NULL THEN 'unavailable' WHEN x >= 65 THEN 'ok' WHEN x >= 45 THEN 'warn' ELSE 'fail' END AS status, CASE WHEN x IS NULL THEN 'N/A' WHEN x >= 75 THEN 'green' WHEN x >= 50 THEN 'yellow' ELSE 'red' END AS pill
 FROM (SELECT pair_id, pitch, unnest([{_DIMS}]) AS k, unnest([{_COLS}]) AS x FROM fu WHERE NOT no_speech)""",
        "b_dims", ctes=_FUSED,
    ),
)
def _cmp18(spark, sf):
    details = {
        "pitch": {
            "val_1": F.expr("100D + pitch"), "val_2": F.lit(150.0), "unit": F.lit("Hz"),
            "delta_label": F.lit("Mean F0 delta"), "delta": F.expr("abs(50D - pitch)"),
        }
    }
    return C.telemetry_rows(C.fuse(b_dims(spark, sf)), details)


@query(
    "cmp19_contour_alignment",
    oracle(
        """SELECT a_id, b_id, j, f0_target, f0_comparison, coalesce(greatest(0e0, lo-20e0), 60e0) AS y_min, coalesce(least(600e0, hi+20e0), 400e0) AS y_max FROM (
 SELECT *, least(min(f0_target) OVER w, min(f0_comparison) OVER w) AS lo, greatest(max(f0_target) OVER w, max(f0_comparison) OVER w) AS hi FROM (
 SELECT a.clip_id AS a_id, b.clip_id AS b_id, a.j, CASE WHEN a.voiced THEN a.f0 END AS f0_target, CASE WHEN b.voiced THEN b.f0 END AS f0_comparison FROM pt a JOIN pt b ON b.clip_id=a.clip_id+1 AND b.j=a.j) WINDOW w AS (PARTITION BY a_id))""",
        "b_pitch",
        ctes="""pt AS (SELECT p.clip_id, j, p.frame_id, p.voiced, p.f0 FROM (SELECT clip_id, count(*) AS n, unnest(range(0,60)) AS j FROM b_pitch GROUP BY 1) c
 JOIN b_pitch p ON p.clip_id = c.clip_id AND p.frame_id = (j*(c.n-1))//59)""",
    ),
)
def _cmp19(spark, sf):
    pts = R.pitch_contour(b_pitch(spark, sf))
    ids = b_pitch(spark, sf).select("clip_id").distinct()
    return C.contour_alignment(neighbours(ids), pts).drop("t")


@query(
    "cmp21_breakdown",
    oracle(
        """SELECT pair_id, CASE WHEN no_speech THEN 'CANNOT COMPARE: No speech detected in ' || concat_ws(', ', CASE WHEN no_speech_1 THEN 'Target Sample' END, CASE WHEN no_speech_2 THEN 'Comparison Sample' END) || '. Ensure uploaded files contain clear speech.'
 ELSE concat_ws(' | ', coalesce('WavLM Neural Verification (wavlm-base-plus-sv): ' || format('{:.1f}', first_neural) || '%', 'WavLM Neural Verification: Offline (model load error — reduced accuracy)'),
 'Secondary Speaker Embedding (ECAPA-TDNN / Wav2Vec2): ' || format('{:.1f}', second_neural) || '%', 'Neural Identity Composite: ' || format('{:.1f}', neural_identity) || '%',
 'Spectral & MFCC Fingerprint: ' || format('{:.1f}', spectral_mfcc) || '%', 'Energy Dynamics: ' || format('{:.1f}', energy) || '%',
 coalesce('Pitch Contour & Intonation: ' || format('{:.1f}', pitch) || '%', 'Pitch Contour: Unavailable'), coalesce('Vocal Tract Formants (F1-F4): ' || format('{:.1f}', formants) || '%', 'Formant Analysis: Unavailable'),
 coalesce('Speaking Rate & Rhythm: ' || format('{:.1f}', rhythm) || '%', 'Rhythm Analysis: Unavailable'),
 CASE WHEN penalty > 0 THEN 'WARNING Deepfake Penalty Applied: -' || format('{:.1f}', penalty) || ' pts (max synthetic risk: ' || format('{:.0f}', max_risk) || '%)' END) END AS breakdown FROM fu""",
        "b_dims", ctes=_FUSED,
    ),
)
def _cmp21(spark, sf):
    return C.fuse(b_dims(spark, sf)).select("pair_id", F.array_join(C.breakdown_lines(), " | ").alias("breakdown"))


