"""The driver tables seen as recording tables, in Spark and as SQL.

Each ``b_*`` function has a twin of the same name in ``BINDING_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions.numbers import round_dp
from voxledger.functions.ordered import SEG, ordered, with_segments


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_round(x: str, d: int) -> str:
    """SQL text of ``round_dp``, by Dekker's split of the product."""
    b = f"{10**d}e0"
    c = f"(({x})*134217729e0)"
    hi = f"({c}-({c}-({x})))"
    p = f"(({x})*{b})"
    e = f"(({hi}*{b}-{p})+(({x})-{hi})*{b})"
    return (
        f"(CASE WHEN {p}-floor({p}) = 0.5e0 THEN CASE WHEN {e}>0 THEN ceil({p}) WHEN {e}<0 THEN floor({p}) "
        f"ELSE 2e0*floor(({p}+0.5e0)/2e0) END ELSE floor({p}+0.5e0) END/{b}+0e0)"
    )


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def micros(c: str) -> Column:
    """Microseconds of a zone-less time read as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


#: Events of a user lie about a minute apart or more; times are cut as numbers with this step.
EVENT_MICROS = 60_000_000


def _numbered_events(spark: SparkSession, sf: str, **cols: Column) -> DataFrame:
    """Events with computed columns and their position inside the user, skew-safe."""
    ev = table(spark, sf, "events").withColumnRenamed("user_id", "clip_id").withColumns(cols)
    ev = with_segments(ev, ["clip_id"], micros("ts"), step=EVENT_MICROS)
    return ordered(ev, ["clip_id"], ["ts", "event_id"], index="idx")


def b_samples(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("event_type").isin("error", "click"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return _numbered_events(spark, sf).select(
        "clip_id", F.col("idx").alias("seq"), (sign * F.col("value") / F.lit(500.0)).alias("x"), SEG
    )


def b_stereo(spark: SparkSession, sf: str) -> DataFrame:
    return b_samples(spark, sf).select(
        "clip_id",
        F.floor(F.col("seq") / 2).alias("seq"),
        (F.col("seq") % 2).cast("int").alias("channel"),
        "x",
    )


def b_pitch(spark: SparkSession, sf: str) -> DataFrame:
    voiced = F.col("event_type").isin("view", "purchase", "signup")
    return _numbered_events(spark, sf).select(
        "clip_id",
        F.col("idx").alias("frame_id"),
        F.when(voiced, F.lit(60.0) + _k() * F.lit(4.0)).alias("f0"),
        voiced.alias("voiced"),
        SEG,
    )


def b_windows(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("idx") * F.lit(0.5)
    scored = _numbered_events(
        spark,
        sf,
        vocoder_score=round_dp(F.lit(0.6) * F.least(F.lit(98.0), F.col("value")), 1),
        spectral_score=round_dp((_k() * _k()).cast("double") / F.lit(99.0), 1),
        prosody_score=(F.col("event_id") % 41).cast("double"),
        boundary_detected=_k() >= 97,
    )
    return scored.select(
        "clip_id", F.col("idx").alias("window_id"), start.alias("start_time"), (start + F.lit(1.5)).alias("end_time"),
        "vocoder_score", "spectral_score", "prosody_score", "boundary_detected", SEG,
    )


def b_vec_windows(spark: SparkSession, sf: str) -> DataFrame:
    em = table(spark, sf, "embeddings").withColumnRenamed("label", "clip_id")
    em = with_segments(em, ["clip_id"], F.col("vec_id"))
    return ordered(em, ["clip_id"], ["vec_id"], index="window_id").select(
        "clip_id",
        "window_id",
        F.transform(F.slice("embedding", 1, 13), lambda v: v.cast("double")).alias("v"),
        SEG,
    )


def b_vec_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Whole vectors of the windows of a clip."""
    em = table(spark, sf, "embeddings")
    return em.select(F.col("label").alias("clip_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))


def b_dims(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")

    def score(mult: int, hole: int | None = None) -> Column:
        v = (key * mult % 101).cast("double")
        return v if hole is None else F.when(key % 10 != hole, v)

    return table(spark, sf, "orders").select(
        key.alias("pair_id"),
        score(7, 0).alias("first_neural"),
        score(29).alias("second_neural"),
        score(11, 1).alias("formants"),
        score(13, 2).alias("pitch"),
        score(17).alias("spectral_mfcc"),
        score(19, 4).alias("rhythm"),
        score(23).alias("energy"),
        (F.col("o_custkey") % 101).cast("double").alias("risk1"),
        (key * 3 % 101).cast("double").alias("risk2"),
        (key % 37 == 5).alias("no_speech_1"),
        (key % 41 == 6).alias("no_speech_2"),
    )


def b_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Wide labelled scores: one row per item."""
    n = F.col("n_chars")
    return (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("item_id"),
            F.col("quality").alias("label"),
            (n % 101).cast("double").alias("s1"),
            ((n * 7 + F.col("quality") * 30) % 101).cast("double").alias("s2"),
            F.when(n % 9 != 0, (n % 1009 + F.col("quality") * 211).cast("double") / F.lit(8.0)).alias("s3"),
        )
    )


def b_cats(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("LIKELY_AUTHENTIC"), F.lit("FULLY_SYNTHETIC"), F.lit("SPLICED_PARTIAL"))
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.get(names, truth).alias("truth"),
        F.get(names, (F.col("doc_id") % 3).cast("int")).alias("pred"),
        (F.col("toxic") == 1).alias("spliced"),
        (F.col("doc_id") % 2).cast("int").alias("n_intervals"),
        (F.col("doc_id") % 5 == 0).cast("int").alias("n_boundaries"),
        F.when(F.col("doc_id") % 17 == 0, "undecodable").alias("error"),
    )


def b_recordings(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(e) for e in (".wav", ".MP3", ".flac", ".txt", ".ogg")]), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("clip_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext)).alias("path"),
        F.length(F.col("text").cast("binary")).cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )


def b_jobs(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"),
        turn.cast("int").alias("stage_index"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + turn * 45).alias("ts"),
        F.when(turn >= 3, F.when(F.col("conv_id") % 4 == 0, "failed").otherwise("completed"))
        .when(turn == 0, "pending")
        .otherwise("running")
        .alias("status"),
    )


def b_access(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.timestamp_micros(micros("ts")).alias("ts")
    )


# text is copied (|| '') so that later joins do not carry the file's dictionary
_EVENTS = """SELECT event_id, ts, event_type || '' AS event_type, value, user_id AS clip_id, CAST(regexp_extract(props,'([0-9]+)',1) AS INTEGER) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events"""

BINDING_SQL: dict[str, str] = {
    "b_events": _EVENTS,
    "b_samples": """SELECT clip_id, idx AS seq,
  CASE WHEN event_type IN ('error','click') THEN -1e0 ELSE 1e0 END * value / 500e0 AS x FROM b_events""",
    "b_stereo": "SELECT clip_id, seq // 2 AS seq, seq % 2 AS channel, x FROM b_samples",
    "b_frames": """SELECT clip_id, seq // 4 AS frame_id, count(*) AS n, sum(x*x) AS ss,
  sqrt(sum(x*x)/count(*)) AS rms, 20e0*log10(greatest(sqrt(sum(x*x)/count(*)),1e-10)) AS rms_db
  FROM b_samples GROUP BY 1, 2""",
    "b_pitch": """SELECT clip_id, idx AS frame_id,
  CASE WHEN event_type IN ('view','purchase','signup') THEN 60e0 + k*4e0 END AS f0,
  event_type IN ('view','purchase','signup') AS voiced FROM b_events""",
    "b_windows": f"""SELECT clip_id, idx AS window_id, idx*0.5e0 AS start_time, idx*0.5e0+1.5e0 AS end_time,
  {sql_round('0.6e0*least(98e0,value)', 1)} AS vocoder_score,
  {sql_round('CAST(k*k AS DOUBLE)/99e0', 1)} AS spectral_score,
  CAST(event_id % 41 AS DOUBLE) AS prosody_score, k >= 97 AS boundary_detected FROM b_events""",
    "b_vec_windows": """SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS window_id,
  CAST(embedding[1:13] AS DOUBLE[]) AS v FROM embeddings""",
    "b_vec_embeddings": "SELECT label AS clip_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "b_dims": """SELECT o_orderkey AS pair_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey*7 % 101 AS DOUBLE) END AS first_neural,
  CAST(o_orderkey*29 % 101 AS DOUBLE) AS second_neural,
  CASE WHEN o_orderkey % 10 <> 1 THEN CAST(o_orderkey*11 % 101 AS DOUBLE) END AS formants,
  CASE WHEN o_orderkey % 10 <> 2 THEN CAST(o_orderkey*13 % 101 AS DOUBLE) END AS pitch,
  CAST(o_orderkey*17 % 101 AS DOUBLE) AS spectral_mfcc,
  CASE WHEN o_orderkey % 10 <> 4 THEN CAST(o_orderkey*19 % 101 AS DOUBLE) END AS rhythm,
  CAST(o_orderkey*23 % 101 AS DOUBLE) AS energy,
  CAST(o_custkey % 101 AS DOUBLE) AS risk1, CAST(o_orderkey*3 % 101 AS DOUBLE) AS risk2,
  o_orderkey % 37 = 5 AS no_speech_1, o_orderkey % 41 = 6 AS no_speech_2 FROM orders""",
    "b_scores": """SELECT l.doc_id AS item_id, quality AS label, CAST(n_chars % 101 AS DOUBLE) AS s1,
  CAST((n_chars*7 + quality*30) % 101 AS DOUBLE) AS s2,
  CASE WHEN n_chars % 9 <> 0 THEN CAST(n_chars % 1009 + quality*211 AS DOUBLE)/8e0 END AS s3
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "b_cats": """SELECT doc_id AS item_id,
  CASE WHEN toxic = 1 THEN 'SPLICED_PARTIAL' WHEN quality = 0 THEN 'FULLY_SYNTHETIC' ELSE 'LIKELY_AUTHENTIC' END AS truth,
  CASE doc_id % 3 WHEN 0 THEN 'LIKELY_AUTHENTIC' WHEN 1 THEN 'FULLY_SYNTHETIC' ELSE 'SPLICED_PARTIAL' END AS pred,
  toxic = 1 AS spliced, CAST(doc_id % 2 AS INTEGER) AS n_intervals,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_boundaries,
  CASE WHEN doc_id % 17 = 0 THEN 'undecodable' END AS error FROM labels""",
    "b_recordings": """SELECT doc_id AS clip_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) ||
  CASE doc_id % 5 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' WHEN 2 THEN '.flac' WHEN 3 THEN '.txt' ELSE '.ogg' END AS path,
  CAST(octet_length(encode(text)) AS BIGINT) AS length, text FROM documents""",
    "b_jobs": """SELECT conv_id AS job_id, CAST(turn AS INTEGER) AS stage_index,
  1704067200 + conv_id*60 + turn*45 AS sec,
  CASE WHEN turn >= 3 THEN CASE WHEN conv_id % 4 = 0 THEN 'failed' ELSE 'completed' END
       WHEN turn = 0 THEN 'pending' ELSE 'running' END AS status FROM conversations""",
    "b_access": "SELECT user_id AS session_id, ts FROM events",
}
_NEEDS = {
    "b_samples": ["b_events"],
    "b_stereo": ["b_samples"],
    "b_frames": ["b_samples"],
    "b_pitch": ["b_events"],
    "b_windows": ["b_events"],
}


def oracle(body: str, *bindings: str, ctes: str = "") -> str:
    """SQL with the named bindings in front, their own needs first."""
    names: list[str] = []

    def add(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            add(dep)
        if name not in names:
            names.append(name)

    for b in bindings:
        add(b)
    parts = [f"{n} AS ({BINDING_SQL[n]})" for n in names]
    if ctes:
        parts.append(ctes)
    return f"WITH {', '.join(parts)} {body}" if parts else body
