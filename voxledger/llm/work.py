"""What the operators share: reading tables, words, packed rows and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^ \t-\r]+"
SPACES = r"[ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows that one Arrow batch carries to Python; documents may be long.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts go to Python, so fewer rows at a time than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local master (tests) gets a temporary folder
    and a cluster gets an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends here."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.array_remove(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)), SPACES), "")


_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, unchanged, in lists that come from about ``size`` bytes each, so that a long text is never a list as a whole."""
    start = 0
    while len(text) - start > size:
        end = _SPACE.search(text, start + size)
        if end is None:
            break
        yield text[start : end.start()].split()
        start = end.end()
    yield text[start:].split()


#: Bits of a bitmap of hashes, in chunks of CHUNK_BITS; a whole one is 16 MB, however many hashes it holds.
BITMAP_BITS, CHUNK_BITS = 1 << 27, 1 << 15


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(BITMAP_BITS))


def bitmap_of(df: DataFrame, key: str) -> DataFrame:
    """At most BITMAP_BITS / CHUNK_BITS rows of 4 kB: a bit for each hash in the column."""
    bit = _bit(F.col(key))
    chunks = df.select(F.floor(bit / CHUNK_BITS).alias("_chunk"), (bit % CHUNK_BITS).alias("_bit"))
    return chunks.groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _has_bit(bits: Column, at: Column) -> Column:
    """Whether a chunk has the bit ``at``."""
    byte = F.hex(F.substring(bits, F.call_function("shiftright", at, F.lit(3)).cast("int") + 1, F.lit(1)))
    digit = F.instr(F.lit("0123456789ABCDEF"), F.substring(byte, F.when(at % 8 < 4, 2).otherwise(1), F.lit(1))) - 1
    return F.call_function("shiftright", digit, (at % 4).cast("int")).bitwiseAND(F.lit(1)) == 1


def maybe_flag(df: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Add a boolean: whether a row's hash may be one of the bitmap's; it never denies one that is."""
    d = df.withColumn("_at", _bit(key)).withColumn("_chunk", F.floor(F.col("_at") / CHUNK_BITS))
    found = _has_bit(F.col("_bits"), F.col("_at") % CHUNK_BITS)
    return d.join(F.broadcast(bitmap), "_chunk", "left").select(*df.columns, F.coalesce(found, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """Rows whose hash may be one of the bitmap's: none of those is lost, a few others stay, in a large corpus more of them."""
    return maybe_flag(df, key, bitmap, "_maybe").where("_maybe").select(*df.columns)


def _bits_of(key: Column, times: int) -> list[Column]:
    return [F.pmod(F.call_function("shiftright", key, F.lit(15 * j + 1)), F.lit(CHUNK_BITS)) for j in range(times)]


def bitmap_by(df: DataFrame, group: str, key: Column, times: int = 1) -> DataFrame:
    """A bitmap in which all hashes of a group have their bits, ``times`` for each, in the same chunk."""
    bits = _bits_of(key, times)
    chunk = F.pmod(F.col(group), F.lit(BITMAP_BITS // CHUNK_BITS)).alias("_chunk")
    d = df.select(chunk, (F.explode(F.array(*bits)) if times > 1 else bits[0]).alias("_bit"))
    return d.groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def with_bits(df: DataFrame, group: str, bitmap: DataFrame) -> DataFrame:
    """Add _bits, the chunk that a row's group has in a bitmap_by(); null if there is none."""
    chunk = F.pmod(F.col(group), F.lit(BITMAP_BITS // CHUNK_BITS))
    return df.withColumn("_chunk", chunk).join(F.broadcast(bitmap), "_chunk", "left").drop("_chunk")


def maybe_has(bits: Column, key: Column, times: int = 1) -> Column:
    """Whether a hash may be one of the chunk's; it never denies one that is. Made for elements of arrays, which need not be exploded."""
    return F.coalesce(reduce(and_, [_has_bit(bits, at) for at in _bits_of(key, times)]), F.lit(False))


def packed(df: DataFrame, outputs: list[str], name: str = "_row") -> tuple[Column, list[str]]:
    """All columns in one struct, so that working columns cannot clash with them.

    Columns that bear the name of an output are left out: the output replaces them.
    """
    keep = [c for c in df.columns if c not in outputs]
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias(name), keep


def unpacked(keep: list[str], name: str = "_row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in keep]
