"""Labelled trials and corpora, seeded by hashes so that any partitioning gives the same draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions.ordered import global_index, ordered, with_cuts


def draw(seed: int, *parts: Column | str) -> Column:
    """Reproducible number in [0, 2^60) from the seed and the parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def hash_order(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Seeded shuffle: ``draw_rank`` is the order, ties broken by the key."""
    return df.withColumn("draw_rank", draw(seed, key)).orderBy("draw_rank", key)


def trial_pairs(files: DataFrame, trials: DataFrame, seed: int = 42, key: str = "file_id") -> DataFrame:
    """One pair per trial: half genuine (two files of a speaker), half impostor (two speakers).

    ``files``: ``key, speaker``; ``trials``: ``trial_id`` (0..).  A trial draws
    speaker and file *numbers* by hash and finds them by equi-join; no pairs are
    formed that are not drawn.  Even trials are genuine.
    """
    sizes = files.groupBy("speaker").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2)
    speakers = global_index(sizes, "speaker", "speaker_no")
    numbered = ordered(
        with_cuts(files.join(sizes, "speaker", "left_semi"), ["speaker"], key), ["speaker"], [key], index="file_no"
    ).select("speaker", "file_no", F.col(key).alias("f"))
    n = sizes.agg(F.count(F.lit(1))).scalar()

    t = trials.select("trial_id", n.alias("n_spk")).withColumn("label", (F.col("trial_id") % 2 == 0).cast("int"))
    first = draw(seed, F.lit("s1"), "trial_id") % F.col("n_spk")
    other = draw(seed, F.lit("s2"), "trial_id") % F.greatest(F.col("n_spk") - 1, F.lit(1))
    t = t.withColumn("no1", first).withColumn(
        "no2", F.when(F.col("label") == 1, F.col("no1")).otherwise(other + (other >= F.col("no1")).cast("long"))
    ).where((F.col("label") == 1) | (F.col("n_spk") > 1))
    s1 = speakers.select(F.col("speaker_no").alias("no1"), F.col("speaker").alias("spk1"), F.col("m").alias("m1"))
    s2 = speakers.select(F.col("speaker_no").alias("no2"), F.col("speaker").alias("spk2"), F.col("m").alias("m2"))
    t = t.join(s1, "no1").join(s2, "no2")
    a = draw(seed, F.lit("f1"), "trial_id") % F.col("m1")
    t = t.withColumn("file_no1", a)
    b_same = draw(seed, F.lit("f2"), "trial_id") % (F.col("m2") - 1)
    b_same = b_same + (b_same >= F.col("file_no1")).cast("long")
    b = F.when(F.col("label") == 1, b_same).otherwise(draw(seed, F.lit("f2"), "trial_id") % F.col("m2"))
    t = t.withColumn("file_no2", b)
    f1 = numbered.select(F.col("speaker").alias("spk1"), F.col("file_no").alias("file_no1"), F.col("f").alias("file1"))
    f2 = numbered.select(F.col("speaker").alias("spk2"), F.col("file_no").alias("file_no2"), F.col("f").alias("file2"))
    return (
        t.join(f1, ["spk1", "file_no1"])
        .join(f2, ["spk2", "file_no2"])
        .select(
            "trial_id", "label", "spk1", "spk2", "file1", "file2",
            F.when(F.col("label") == 1, "genuine").otherwise("impostor").alias("pair_type"),
            draw(seed, F.lit("order"), "trial_id").alias("draw_rank"),
        )
    )


def drawn(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by hash of the key."""
    return df.orderBy(draw(seed, key), key).limit(n)


def labelled_corpus(bona_fide: DataFrame, synthetic: DataFrame, spliced: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """All rows of each class, or ``n`` drawn by hash, with label, truth, splice interval and ``draw_rank``.

    Inputs: ``file_id, path``; spliced also ``t_start, t_end``.
    """
    def part(df: DataFrame, label: int, truth: str, kind: str, is_spliced: bool) -> DataFrame:
        return (df if n is None else drawn(df, "file_id", n, seed)).select(
            *df.columns, F.lit(label).alias("label"), F.lit(truth).alias("category_ground_truth"),
            F.lit(kind).alias("sample_type"), F.lit(is_spliced).alias("is_spliced"),
        )

    corpus = (
        part(bona_fide, 0, K.AUTHENTIC, "bona_fide", False)
        .unionByName(part(synthetic, 1, K.SYNTHETIC, "synthetic_vits_tts", False), allowMissingColumns=True)
        .unionByName(part(spliced, 1, K.SPLICED, "spliced_neural_hybrid", True), allowMissingColumns=True)
    )
    return corpus.withColumn("draw_rank", draw(seed, "sample_type", "file_id"))


