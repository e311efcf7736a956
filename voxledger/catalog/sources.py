"""Source and corpus queries (SRC-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.catalog.bindings import b_recordings, b_samples, oracle, sql_round, table
from voxledger.catalog.registry import query
from voxledger.operators import prepare as P
from voxledger.operators import windows as W
from voxledger.session import shared_dir
from voxledger.sources import documents as D
from voxledger.sources import pcm, recordings, splice, trials


@query(
    "src1_validation",
    oracle(
        """SELECT clip_id, length, CASE WHEN NOT regexp_matches(lower(path), '\\.(wav|mp3|flac|ogg|m4a)$') THEN 'unsupported_format' WHEN length = 0 THEN 'empty' WHEN length > 2000 THEN 'too_large' END AS reject_reason FROM b_recordings""",
        "b_recordings",
    ),
)
def _src1b(spark, sf):
    return b_recordings(spark, sf).select("clip_id", "length", recordings.reject_reason(max_bytes=2000).alias("reject_reason"))


@query(
    "src2_custody",
    oracle(
        f"SELECT clip_id, sha256(text) AS sha256, {sql_round('length/16000e0', 3)} AS raw_sec, {sql_round('length/32000e0', 3)} AS speech_sec, 16000 AS sample_rate FROM b_recordings",
        "b_recordings",
    ),
)
def _src2(spark, sf):
    d = recordings.with_custody(b_recordings(spark, sf))
    held = recordings.custody_durations(F.col("length"), F.col("length") / F.lit(2.0))
    return d.select("clip_id", "sha256", held.alias("h")).selectExpr(
        "clip_id", "sha256", "h.raw_duration_sec AS raw_sec", "h.speech_duration_sec AS speech_sec", "h.sample_rate"
    )


@query(
    "src3_content_dedup",
    oracle(
        "SELECT clip_id, md5(text) AS content_md5, min(clip_id) OVER (PARTITION BY md5(text)) AS canonical_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM b_recordings",
        "b_recordings",
    ),
)
def _src3(spark, sf):
    return recordings.dedup_by_content(b_recordings(spark, sf))


@query(
    "src3_compute_once",
    oracle("SELECT min(clip_id) AS clip_id, md5(text) AS content_md5, any_value(length) AS length FROM b_recordings GROUP BY md5(text)", "b_recordings"),
)
def _src3b(spark, sf):
    return recordings.compute_once(b_recordings(spark, sf)).select("clip_id", "content_md5", "length")


@query(
    "src4_pcm_roundtrip",
    oracle(
        """SELECT clip_id, seq // 16 AS part, count(*) AS n, CAST(sum(round_even(greatest(-32768e0, least(32767e0, round_even(x*32768e0, 0))), 0)) AS BIGINT) AS total
 FROM b_samples GROUP BY 1,2""",
        "b_samples",
    ),
)
def _src4(spark, sf):
    """Samples written as WAV bytes of 16 samples and decoded again."""
    fr = P.frames_from_samples(b_samples(spark, sf), 4).withColumn("pos", F.col("frame_id") * 4)
    parts = W.to_blocks(fr, 16).withColumn("key", F.concat_ws(":", "clip_id", "block_id"))
    wav = pcm.encode_wav(parts, key="key")
    blocks = pcm.downmix_blocks(pcm.pcm_blocks(wav, block_len=4, key="key"), key="key")
    return (
        blocks.select(F.split("key", ":").alias("k"), F.explode("xs").alias("x"))
        .groupBy(F.col("k")[0].cast("long").alias("clip_id"), F.col("k")[1].cast("long").alias("part"))
        .agg(F.count("x").alias("n"), F.sum(F.rint(F.col("x") * 32768.0)).cast("long").alias("total"))
    )


@query(
    "src5_speaker_index",
    oracle(
        """SELECT speaker, count(*) AS n_files FROM (SELECT split_part(path, '/', 1) AS speaker FROM b_recordings WHERE path LIKE '%.flac'
 UNION ALL SELECT split_part(path, '/', 2) FROM b_recordings WHERE NOT path LIKE '%.flac') GROUP BY 1 HAVING count(*) >= 2""",
        "b_recordings",
    ),
)
def _src5(spark, sf):
    """Two trees: one with the speaker two folders above a file, one with the speaker's folder right above it."""
    files = b_recordings(spark, sf)
    primary = recordings.with_speaker(files.where("path LIKE '%.flac'"), depth=2)
    return recordings.speaker_index(primary, recordings.with_speaker(files.where("NOT path LIKE '%.flac'")))


def speaker_files(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("spk"), F.expr("c_custkey % 37")).alias("speaker"))


def _draw(*parts: str) -> str:
    key = " || '|' || ".join(["'42'", *parts])
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


_TRIALS = f"""sf AS (SELECT c_custkey AS f, 'spk' || (c_custkey % 37) AS speaker FROM customer),
sz AS (SELECT speaker, count(*) AS m FROM sf GROUP BY 1 HAVING count(*) >= 2),
sn AS (SELECT *, row_number() OVER (ORDER BY md5(speaker), speaker) - 1 AS no FROM sz),
fn AS (SELECT sf.*, row_number() OVER (PARTITION BY speaker ORDER BY f) - 1 AS fno FROM sf JOIN sz USING (speaker)),
t0 AS (SELECT o_orderkey AS trial_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS label, (SELECT count(*) FROM sz) AS ns FROM orders),
t1 AS (SELECT *, {_draw("'s1'", "trial_id::VARCHAR")} % ns AS no1, {_draw("'s2'", "trial_id::VARCHAR")} % greatest(ns-1,1) AS o2 FROM t0),
t2 AS (SELECT *, CASE WHEN label=1 THEN no1 ELSE o2 + CASE WHEN o2 >= no1 THEN 1 ELSE 0 END END AS no2 FROM t1),
t3 AS (SELECT t2.*, a.speaker AS spk1, a.m AS m1, b.speaker AS spk2, b.m AS m2 FROM t2 JOIN sn a ON a.no=no1 JOIN sn b ON b.no=no2),
t4 AS (SELECT *, {_draw("'f1'", "trial_id::VARCHAR")} % m1 AS i1, {_draw("'f2'", "trial_id::VARCHAR")} AS r2 FROM t3),
t5 AS (SELECT *, CASE WHEN label=1 THEN r2 % (m2-1) + CASE WHEN r2 % (m2-1) >= i1 THEN 1 ELSE 0 END ELSE r2 % m2 END AS i2 FROM t4)"""


@query(
    "src6_trial_pairs",
    oracle(
        """SELECT trial_id, label, spk1, spk2, a.f AS file1, b.f AS file2, CASE WHEN label=1 THEN 'genuine' ELSE 'impostor' END AS pair_type FROM t5
 JOIN fn a ON a.speaker=spk1 AND a.fno=i1 JOIN fn b ON b.speaker=spk2 AND b.fno=i2""",
        ctes=_TRIALS,
    ),
)
def _src6(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"))
    return trials.trial_pairs(speaker_files(spark, sf), t).drop("draw_rank")


def _pairs(spark, sf) -> DataFrame:
    """Clip c receives a donor stretch from clip c+1."""
    ids = table(spark, sf, "events").select(F.col("user_id").alias("host_id")).distinct()
    donors = ids.select((F.col("host_id") - 1).alias("host_id"), F.col("host_id").alias("donor_id"))
    return ids.join(donors, "host_id").select((F.col("host_id") + 1000000).alias("clip_id"), "host_id", "donor_id")


@query(
    "src7_splice",
    oracle(
        """SELECT clip_id, seq, round(CASE WHEN top > 0 THEN x/top*0.85e0 ELSE x END,6) AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY clip_id) AS top FROM (
 SELECT p.clip_id, p.seq, CASE WHEN p.seq >= 15 AND p.seq < 30 THEN coalesce(d.x*hr/dr, 0e0) ELSE p.hx END AS x FROM po p JOIN lv USING (clip_id) LEFT JOIN b_samples d ON d.clip_id = p.donor_id AND d.seq = p.seq-15 AND d.seq < 15))""",
        "b_samples",
        ctes="""pr AS (SELECT DISTINCT a.clip_id+1000000 AS clip_id, a.clip_id AS host_id, a.clip_id+1 AS donor_id FROM b_samples a WHERE EXISTS (SELECT 1 FROM b_samples b WHERE b.clip_id = a.clip_id+1)),
ln AS (SELECT clip_id AS host_id, count(*) AS n FROM b_samples GROUP BY 1),
ps AS (SELECT pr.*, unnest(range(0, greatest(n, 80))) AS seq FROM pr JOIN ln USING (host_id)),
po AS (SELECT ps.*, coalesce(s.x, 0e0) AS hx FROM ps LEFT JOIN b_samples s ON s.clip_id = host_id AND s.seq = ps.seq),
hv AS (SELECT clip_id, sqrt(sum(hx*hx)/15e0+1e-6) AS hr FROM po WHERE seq >= 15 AND seq < 30 GROUP BY 1),
dv AS (SELECT pr.clip_id, sqrt(sum(x*x)/15e0+1e-6) AS dr FROM pr JOIN b_samples s ON s.clip_id = donor_id AND seq < 15 GROUP BY 1),
lv AS (SELECT * FROM hv JOIN dv USING (clip_id))""",
    ),
)
def _src7(spark, sf):
    d = splice.splice_insert(b_samples(spark, sf), _pairs(spark, sf), 15, 30, 80)
    return d.select("clip_id", "seq", F.round("x", 6).alias("x"))


def _files(spark, sf, name: str, key: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(key).alias("file_id"), F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"))


@query(
    "src8_labelled_corpus",
    oracle(
        """SELECT file_id, path, 0 AS label, 'LIKELY_AUTHENTIC' AS category_ground_truth, 'bona_fide' AS sample_type, false AS is_spliced, NULL::DOUBLE AS t_start, NULL::DOUBLE AS t_end FROM
 (SELECT c_custkey AS file_id, 'customer/' || c_custkey AS path FROM customer)
 UNION ALL SELECT file_id, path, 1, 'FULLY_SYNTHETIC', 'synthetic_vits_tts', false, NULL, NULL FROM (SELECT s_suppkey AS file_id, 'supplier/' || s_suppkey AS path FROM supplier)
 UNION ALL SELECT file_id, path, 1, 'SPLICED_PARTIAL', 'spliced_neural_hybrid', true, 1.5, 3.0 FROM (SELECT p_partkey AS file_id, 'part/' || p_partkey AS path FROM part)""",
    ),
)
def _src8(spark, sf):
    spliced = _files(spark, sf, "part", "p_partkey").withColumns({"t_start": F.lit(1.5), "t_end": F.lit(3.0)})
    d = trials.labelled_corpus(_files(spark, sf, "customer", "c_custkey"), _files(spark, sf, "supplier", "s_suppkey"), spliced)
    return d.drop("draw_rank")


@query(
    "src9_document_roundtrip",
    oracle("SELECT clip_id, path, length FROM b_recordings", "b_recordings"),
)
def _src9(spark, sf):
    """Rows written as JSON documents to the shared folder and read back."""
    import uuid

    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    D.write_documents(b_recordings(spark, sf).select("clip_id", "path", "length"), path)
    return D.read_documents(spark, path, "clip_id bigint, path string, length bigint")


@query("src10_hash_order", oracle(f"SELECT c_custkey AS file_id, {_draw('c_custkey::VARCHAR')} AS draw_rank FROM customer"))
def _src10(spark, sf):
    return trials.hash_order(speaker_files(spark, sf).select("file_id"), 42, "file_id")
