"""Scan queries: windows to verdicts (IND-15/16, SYN-*, WIN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.catalog.bindings import b_windows, oracle, sql_round
from voxledger.catalog.registry import query
from voxledger.operators import synthesis as S

_FLAGS = f"""w0 AS (SELECT *, 0.40e0*spectral_score+0.35e0*vocoder_score+0.25e0*prosody_score AS raw FROM b_windows),
w AS (SELECT *, {sql_round('raw', 1)} AS combined_score, ({sql_round('raw', 1)} >= 38 OR spectral_score >= 88) AS is_suspicious FROM w0)"""

_SIGNALS = f"""r AS (SELECT *, CAST(round(vocoder_score*10) AS BIGINT) AS v10, CAST(round(spectral_score*10) AS BIGINT) AS s10,
 CAST(round(prosody_score*10) AS BIGINT) AS p10, count(*) OVER (PARTITION BY clip_id) AS n,
 row_number() OVER (PARTITION BY clip_id ORDER BY vocoder_score DESC, window_id) AS rv,
 row_number() OVER (PARTITION BY clip_id ORDER BY spectral_score DESC, window_id) AS rs FROM b_windows),
sig0 AS (SELECT clip_id, max(n) AS n_windows,
 sum(CASE WHEN rv <= greatest(1, n//4) THEN v10 END)/10e0/count(CASE WHEN rv <= greatest(1, n//4) THEN 1 END) AS v,
 sum(CASE WHEN rs <= least(2, n) THEN s10 END)/10e0/count(CASE WHEN rs <= least(2, n) THEN 1 END) AS s,
 sum(p10)/10e0/count(*) AS p FROM r GROUP BY clip_id),
sig AS (SELECT clip_id, n_windows, {sql_round('v', 1)} AS vocoder, {sql_round('s', 1)} AS spectral, {sql_round('p', 1)} AS prosody FROM sig0)"""

_INTERVALS = """f0 AS (SELECT *, max(end_time) OVER (PARTITION BY clip_id ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
 FROM w WHERE is_suspicious),
f1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach + 0.55e0 THEN 1 ELSE 0 END)
 OVER (PARTITION BY clip_id ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS island FROM f0),
iv AS (SELECT clip_id, island, min(start_time) AS t_start, max(end_time) AS t_end, count(*) AS n_windows,
 max(end_time)-min(start_time) AS duration_sec FROM f1 GROUP BY clip_id, island)"""

_VERDICT = f"""m AS (SELECT DISTINCT clip_id, CAST(clip_id*37 % 101 AS DOUBLE) AS model FROM b_windows),
fl AS (SELECT clip_id, max(end_time) AS duration_sec, count(*) FILTER (is_suspicious) AS n_flagged,
 count(*) FILTER (boundary_detected) AS n_boundaries FROM w GROUP BY clip_id),
c0 AS (SELECT m.clip_id, model, duration_sec, n_windows, vocoder, spectral, prosody, n_flagged AS nf, n_boundaries,
 spectral*0.35e0+vocoder*0.30e0+prosody*0.25e0+model*0.10e0 AS raw FROM m JOIN sig USING (clip_id) JOIN fl USING (clip_id)),
c1 AS (SELECT *, greatest(1e0, least(99e0, {sql_round('raw', 1)})) AS composite FROM c0),
c2 AS (SELECT *, (nf = 1 AND composite < 46 AND model < 20 AND n_boundaries = 0) AS suppressed FROM c1),
sp AS (SELECT clip_id, count(*) AS ni, sum(t_end-t_start) AS span FROM iv GROUP BY clip_id),
c3 AS (SELECT c2.*, CASE WHEN suppressed THEN 0 ELSE nf END AS n_flagged, CASE WHEN suppressed THEN 0 ELSE coalesce(ni,0) END AS n_intervals,
 CASE WHEN suppressed THEN 0e0 ELSE coalesce(span,0e0) END AS span_sec FROM c2 LEFT JOIN sp USING (clip_id)),
c4 AS (SELECT *, span_sec/greatest(duration_sec,0.1e0) AS span_ratio, n_flagged/CAST(n_windows AS DOUBLE) AS flag_ratio FROM c3),
c5 AS (SELECT *, CASE WHEN (composite>=32 AND model>=60 AND (vocoder>=27 OR prosody>=12)) OR (composite>=32 AND span_ratio>=0.40e0)
   OR (composite>=34 AND flag_ratio>=0.35e0) THEN 'FULLY_SYNTHETIC'
  WHEN (n_boundaries>0 AND composite>=28) OR (n_intervals>0 AND span_ratio BETWEEN 0.05e0 AND 0.65e0 AND composite>=32)
   OR (spectral>=45 AND composite>=32 AND span_ratio<=0.65e0 AND n_intervals>0) THEN 'SPLICED_PARTIAL' ELSE 'LIKELY_AUTHENTIC' END AS category FROM c4),
c6 AS (SELECT *, CASE WHEN composite>=70 THEN 'DEEPFAKE' WHEN category='SPLICED_PARTIAL' THEN 'SUSPICIOUS' WHEN composite>=40 THEN 'UNCERTAIN' ELSE 'REAL' END AS label,
 CASE WHEN composite>=85 THEN 'HIGH' WHEN composite>=70 OR composite>=40 OR category='SPLICED_PARTIAL' OR composite>=20 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
 CASE category WHEN 'FULLY_SYNTHETIC' THEN 'Entirely Synthetic / AI-Generated Speech'
  WHEN 'SPLICED_PARTIAL' THEN 'Partial Splicing / Localized Synthetic Injection' ELSE 'Likely Authentic Human Speech' END AS category_label FROM c5)"""


def _sql(body: str, *ctes: str) -> str:
    return oracle(body, "b_windows", ctes=", ".join(ctes))


def models(windows: DataFrame) -> DataFrame:
    """Stand-in whole-clip model score and clip length."""
    return windows.groupBy("clip_id").agg(
        (F.first("clip_id") * 37 % 101).cast("double").alias("model"), F.max("end_time").alias("duration_sec")
    )


def verdicts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = b_windows(spark, sf)
    clips, intervals = S.synthesise(w, models(w))
    return w, clips, intervals


@query(
    "ind15_combined_suspicion",
    _sql("SELECT clip_id, window_id, combined_score, is_suspicious FROM w", _FLAGS),
)
def _ind15(spark, sf):
    return S.flag_windows(b_windows(spark, sf)).select("clip_id", "window_id", "combined_score", "is_suspicious")


@query(
    "syn1_top_quartile_mean",
    _sql("SELECT clip_id, vocoder FROM sig", _SIGNALS),
)
def _syn1(spark, sf):
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return S.topk_mean(b_windows(spark, sf), ["clip_id"], "vocoder_score", k, "vocoder")


@query("syn2_top_two_mean", _sql("SELECT clip_id, spectral FROM sig", _SIGNALS))
def _syn2(spark, sf):
    return S.topk_mean(b_windows(spark, sf), ["clip_id"], "spectral_score", F.least(F.lit(2), F.col("n")), "spectral")


@query("syn3_signal_scores", _sql("SELECT clip_id, n_windows, vocoder, spectral, prosody FROM sig", _SIGNALS))
def _syn3(spark, sf):
    return S.signal_scores(b_windows(spark, sf)).select("clip_id", "n_windows", "vocoder", "spectral", "prosody")


@query("syn4_composite", _sql("SELECT clip_id, model, composite FROM c1", _FLAGS, _SIGNALS, _INTERVALS, _VERDICT))
def _syn4(spark, sf):
    w = b_windows(spark, sf)
    d = models(w).join(S.signal_scores(w), "clip_id", "left")
    return S.with_empty_defaults(d).select("clip_id", "model", S.composite_score().alias("composite"))


@query(
    "syn5_boundary_times",
    _sql("SELECT clip_id, window_id, (start_time+end_time)/2e0 AS t FROM b_windows WHERE boundary_detected"),
)
def _syn5(spark, sf):
    return S.boundary_times(b_windows(spark, sf)).select("clip_id", "window_id", "t")


@query(
    "syn6_lone_flag",
    _sql("SELECT clip_id, nf AS raw_flags, suppressed, n_flagged, n_intervals FROM c3", _FLAGS, _SIGNALS, _INTERVALS, _VERDICT),
)
def _syn6(spark, sf):
    w, clips, _ = verdicts(spark, sf)
    raw = S.flag_windows(w).groupBy("clip_id").agg(F.sum(F.col("is_suspicious").cast("long")).alias("raw_flags"))
    return clips.join(raw, "clip_id").select("clip_id", "raw_flags", "suppressed", "n_flagged", "n_intervals")


@query(
    "syn7_merge_intervals",
    _sql("SELECT clip_id, t_start, t_end, n_windows, duration_sec FROM iv", _FLAGS, _INTERVALS),
)
def _syn7(spark, sf):
    return S.suspect_intervals(b_windows(spark, sf)).select("clip_id", "t_start", "t_end", "n_windows", "duration_sec")


@query(
    "syn8_span_and_flag_ratio",
    _sql(
        "SELECT clip_id, round(span_ratio,6) AS span_ratio, round(flag_ratio,6) AS flag_ratio, n_intervals FROM c4",
        _FLAGS, _SIGNALS, _INTERVALS, _VERDICT,
    ),
)
def _syn8(spark, sf):
    _, clips, _ = verdicts(spark, sf)
    return clips.select("clip_id", F.round("span_ratio", 6).alias("span_ratio"), F.round("flag_ratio", 6).alias("flag_ratio"), "n_intervals")


@query("syn9_category", _sql("SELECT clip_id, category, category_label FROM c6", _FLAGS, _SIGNALS, _INTERVALS, _VERDICT))
def _syn9(spark, sf):
    _, clips, _ = verdicts(spark, sf)
    return clips.select("clip_id", "category", "category_label")


@query("syn10_label_confidence", _sql("SELECT clip_id, composite, label, confidence FROM c6", _FLAGS, _SIGNALS, _INTERVALS, _VERDICT))
def _syn10(spark, sf):
    _, clips, _ = verdicts(spark, sf)
    return clips.select("clip_id", "composite", "label", "confidence")


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SIGNAL_NAMES.items())
_PCT = "format('{:.0f}', {})"


@query(
    "syn11_signal_disagreements",
    _sql(
        """SELECT clip_id, CASE high """ + _NAMES + """ END AS signal_high, CASE low """ + _NAMES + """ END AS signal_low,
 sh AS score_high, sl AS score_low, """ + sql_round("d", 1) + """ AS delta,
 CASE high """ + _NAMES + """ END || ' scored ' || format('{:.0f}', sh) || '% while ' || CASE low """ + _NAMES + """ END
 || ' scored ' || format('{:.0f}', sl) || '% — a ' || format('{:.0f}', d) || '% divergence.' || CASE WHEN high = 'spectral' THEN
 ' A spectral-only spike without prosody/vocoder elevation is characteristic of a splice point rather than fully synthetic speech.' ELSE '' END AS message
 FROM dis""",
        _FLAGS, _SIGNALS, _INTERVALS, _VERDICT,
        """u AS (SELECT clip_id, unnest(['model','vocoder','spectral','prosody']) AS s, unnest([model,vocoder,spectral,prosody]) AS x, unnest([1,2,3,4]) AS i FROM c1),
dis AS (SELECT a.clip_id, CASE WHEN a.x>b.x THEN a.s ELSE b.s END AS high, CASE WHEN a.x>b.x THEN b.s ELSE a.s END AS low,
 greatest(a.x,b.x) AS sh, least(a.x,b.x) AS sl, abs(a.x-b.x) AS d FROM u a JOIN u b ON a.clip_id=b.clip_id AND a.i<b.i WHERE abs(a.x-b.x) >= 35)""",
    ),
)
def _syn11(spark, sf):
    _, clips, _ = verdicts(spark, sf)
    return S.signal_disagreements(clips)


@query(
    "syn12_splice_only",
    _sql(
        """SELECT clip_id, 'Spectral Consistency [TEMPORAL HEURISTIC]' AS signal_high, 'Vocoder Artifacts + Prosody [HEURISTICS]' AS signal_low,
 'Spectral boundary markers detected at ' || string_agg(format('{:.1f}s', start_time), ', ' ORDER BY window_id) ||
 ' without corresponding vocoder or prosody elevation. This pattern strongly suggests a SPLICE POINT in a natural recording rather than fully synthetic speech.' AS message
 FROM q WHERE rn <= 3 GROUP BY clip_id""",
        """q AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY window_id) AS rn FROM b_windows
 WHERE boundary_detected AND vocoder_score < 45 AND prosody_score < 45)""",
    ),
)
def _syn12(spark, sf):
    return S.splice_only_message(b_windows(spark, sf))


_TEXT = """ivr AS (SELECT iv.*, row_number() OVER (PARTITION BY iv.clip_id ORDER BY t_start) AS rn FROM iv JOIN c3 ON c3.clip_id = iv.clip_id AND NOT suppressed),
ivt AS (SELECT clip_id, string_agg(CAST(t_start AS VARCHAR) || 's–' || CAST(t_end AS VARCHAR) || 's', ', ' ORDER BY t_start) AS ivs FROM ivr WHERE rn <= 3 GROUP BY clip_id),
mkr AS (SELECT clip_id, (start_time+end_time)/2e0 AS t, row_number() OVER (PARTITION BY clip_id ORDER BY window_id) AS rn FROM b_windows WHERE boundary_detected),
mkt AS (SELECT clip_id, string_agg(CAST(t AS VARCHAR) || 's', ', ' ORDER BY t) AS marks FROM mkr WHERE rn <= 4 GROUP BY clip_id),
tx AS (SELECT c.clip_id, category, CASE category
 WHEN 'FULLY_SYNTHETIC' THEN 'High-confidence synthetic audio detected (Anomaly Index: ' || format('{:.0f}', composite) || '%). The primary neural spoof classifier (' || format('{:.0f}', model) || '%), vocoder artifact indicators (' || format('{:.0f}', vocoder) || '%), and prosody analysis (' || format('{:.0f}', prosody) || '%) collectively indicate the entire voice track was generated via TTS or voice cloning.'
 WHEN 'SPLICED_PARTIAL' THEN 'Partial audio manipulation detected (Anomaly Index: ' || format('{:.0f}', composite) || '%). Suspicious segments localized at: [' || coalesce(ivs, '') || '].' || coalesce(' Splice boundary markers were detected at: ' || marks || '.', '') || ' The spectral inconsistency indicator flagged abrupt acoustic environment changes characteristic of a recording splice.'
 ELSE 'Acoustic profile is consistent with natural unmanipulated human speech (Anomaly Index: ' || format('{:.0f}', composite) || '%). Pitch micro-variability (' || format('{:.0f}', prosody) || '% prosody score), harmonic-to-noise ratios (' || format('{:.0f}', vocoder) || '% vocoder score), and spectral continuity are within natural human phonation ranges across all time windows.' END AS interpretation
 FROM c6 c LEFT JOIN ivt USING (clip_id) LEFT JOIN mkt USING (clip_id))"""


@query("syn13_interpretation", _sql("SELECT * FROM tx", _FLAGS, _SIGNALS, _INTERVALS, _VERDICT, _TEXT))
def _syn13(spark, sf):
    w, clips, intervals = verdicts(spark, sf)
    return S.interpretation(clips, intervals, w)


@query(
    "syn14_timeline_axis",
    _sql(
        """SELECT clip_id, window_id, floor((start_time+end_time)/2e0*10e0+0.5e0)/10e0 AS t, axis_end FROM b_windows
 JOIN (SELECT clip_id, max(end_time) AS axis_end FROM b_windows GROUP BY 1) USING (clip_id)""",
    ),
)
def _syn14(spark, sf):
    from voxledger.functions.ordered import attach, seg_of

    w = b_windows(spark, sf)
    segs = w.groupBy("clip_id").agg(seg_of(w, F.max))
    axis = S.timeline_axis(w, models(w)).join(segs, "clip_id")
    return attach(S.timeline_points(w), axis, ["clip_id"]).select("clip_id", "window_id", "t", "axis_end")


@query(
    "syn15_clip_documents",
    _sql(
        """SELECT c.clip_id, window_id // 16 AS part, any_value(label) AS label, any_value(composite) AS composite, count(*) AS n,
 string_agg(CAST(window_id AS VARCHAR) || ':' || CAST(combined_score AS VARCHAR) || ':' || CAST(is_suspicious AS VARCHAR), ' ' ORDER BY window_id) AS timeline
 FROM w JOIN c6 c ON c.clip_id = w.clip_id GROUP BY 1, 2""",
        _FLAGS, _SIGNALS, _INTERVALS, _VERDICT,
    ),
)
def _syn15(spark, sf):
    w, clips, _ = verdicts(spark, sf)
    docs = S.clip_documents(clips, w, part_size=16)
    line = F.transform(
        "suspicion_timeline",
        lambda r: F.concat_ws(":", r["window_id"].cast("string"), r["combined_score"].cast("string"), r["is_suspicious"].cast("string")),
    )
    return docs.select("clip_id", "part", "label", "composite", F.size("suspicion_timeline").cast("long").alias("n"), F.array_join(line, " ").alias("timeline"))


FLAGSHIP_SQL = _sql(
    """SELECT clip_id, t_start, t_end, iv.duration_sec, composite, label, confidence, category,
 round(span_ratio,6) AS span_ratio FROM iv JOIN c6 USING (clip_id) WHERE NOT suppressed""",
    _FLAGS, _SIGNALS, _INTERVALS, _VERDICT,
)


@query("scan_suspect_regions", FLAGSHIP_SQL)
def flagship(spark, sf) -> DataFrame:
    """Which clips hold suspicious regions, and where?  One row per interval."""
    w = b_windows(spark, sf)
    d = S.suspect_regions(w, models(w), ["composite", "label", "confidence", "category", "span_ratio"])
    return d.withColumnRenamed("interval_sec", "duration_sec").withColumn("span_ratio", F.round("span_ratio", 6))
