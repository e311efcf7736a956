"""Recordings as a table: scan, custody, content identity, speakers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.numbers import round_dp


def reject_reason(extensions: Sequence[str] = K.EXTENSIONS, max_bytes: int | None = None) -> Column:
    """Why a file is not accepted; null for a good one.  No size is too large unless ``max_bytes`` says so."""
    known = "(?i)(" + "|".join(e.replace(".", "\\.") for e in extensions) + ")$"
    reason = F.when(~F.col("path").rlike(known), "unsupported_format").when(F.col("length") == 0, "empty")
    return reason if max_bytes is None else reason.when(F.col("length") > max_bytes, "too_large")


def clip_name(path: Column, root: str) -> Column:
    """Path of a file below ``root``, the whole path where it lies elsewhere.

    Folders are part of the name: recordings of several speakers often share base names.
    """
    below = re.sub(r"^[a-z][a-z0-9+.-]*:/*(?=/)", "", root, flags=re.IGNORECASE).rstrip("/")
    if re.search(r"[*?\[{]", below):
        return path
    return F.regexp_replace(path, F.lit(rf"^(?i:[a-z][a-z0-9+.-]*:/*(?=/))?\Q{below}\E/"), F.lit(""))


def scan_recordings(
    spark: SparkSession, path: str, extensions: Sequence[str] = K.EXTENSIONS, max_bytes: int | None = None
) -> DataFrame:
    """All files under ``path`` with their reject reason; ``clip_id`` is the path below it.

    Bytes are only read where ``content`` is used; a filter on ``length``
    reaches the file listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("reject_reason", reject_reason(extensions, max_bytes)).withColumn(
        "clip_id", clip_name(F.col("path"), path)
    )


def accepted(recordings: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Good files; the bounds on ``length`` reach the file listing."""
    good = (F.col("length") > 0) & F.col("reject_reason").isNull()
    return recordings.where(good if max_bytes is None else good & (F.col("length") <= max_bytes))


def with_custody(df: DataFrame, content: str = "content") -> DataFrame:
    """sha-256 of the raw bytes."""
    return df.withColumn("sha256", F.sha2(F.col(content), 256))


def custody_durations(raw_samples: Column, speech_samples: Column, sr: int = K.SAMPLE_RATE) -> Column:
    return F.struct(
        round_dp(raw_samples / F.lit(float(sr)), 3).alias("raw_duration_sec"),
        round_dp(speech_samples / F.lit(float(sr)), 3).alias("speech_duration_sec"),
        F.lit(sr).alias("sample_rate"),
    )


def dedup_by_content(df: DataFrame, content: str = "content", key: str = "clip_id") -> DataFrame:
    """Map every recording to the one that is computed for its content.

    One row per recording: ``key, content_md5, canonical_id, copies``.  The
    group of copies is reduced to (min, count) before it is joined back, so a
    content that fills the table is not gathered.
    """
    keyed = df.select(key, F.md5(F.col(content)).alias("content_md5"))
    groups = keyed.groupBy("content_md5").agg(F.min(key).alias("canonical_id"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups, "content_md5")


def compute_once(df: DataFrame, content: str = "content", key: str = "clip_id") -> DataFrame:
    """One recording per distinct content: that with the smallest key.

    Keys and digests alone are grouped.  The recordings that are kept are found
    by key and digest, so bytes are moved once at most.
    """
    rest = [c for c in df.columns if c not in (key, content)]
    d = df.withColumn("content_md5", F.md5(F.col(content)))
    canon = d.select(key, "content_md5").groupBy("content_md5").agg(F.min(key).alias(key))
    return d.join(canon, ["content_md5", key], "left_semi").select(key, content, *rest, "content_md5")


def with_speaker(df: DataFrame, depth: int = 1) -> DataFrame:
    """Speaker = name of the folder ``depth`` levels above the file."""
    pattern = "([^/]+)/" + "[^/]+/" * (depth - 1) + "[^/]+$"
    return df.withColumn("speaker", F.regexp_extract("path", pattern, 1))


def speaker_index(*trees: DataFrame, min_files: int = 2) -> DataFrame:
    """Files per speaker, over all ``trees`` given, for speakers with at least ``min_files``.

    Trees may keep speakers at different depths (``with_speaker``); a speaker of
    several trees has the files of all.
    """
    sizes = reduce(DataFrame.union, [t.select("speaker") for t in trees]).groupBy("speaker").agg(F.count(F.lit(1)).alias("n_files"))
    return sizes.where(F.col("n_files") >= min_files)
