"""Uncompressed WAV bytes to sample blocks and back."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import constants as K

BLOCK = 8000


def _chunks(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Offsets and sizes of the RIFF chunks."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not_riff_wave")
    found, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        found.setdefault(name, (at + 8, min(size, len(data) - at - 8)))
        at += 8 + size + (size & 1)
    return found


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file lie and how they are coded."""

    rate: int
    channels: int
    coding: int
    bits: int
    at: int
    n: int

    def samples(self, data: bytes, start: int, stop: int) -> np.ndarray:
        """Samples x channels in [-1, 1] of a stretch of the file; nothing else is decoded."""
        width = self.bits // 8
        step = self.channels * width
        raw = np.frombuffer(data, dtype=np.uint8, count=(stop - start) * step, offset=self.at + start * step)
        if self.coding == 3:
            x = raw.view(f"<f{width}").astype(float)
        elif self.bits == 8:
            x = (raw.astype(float) - 128.0) / 128.0
        elif self.bits == 24:
            b = raw.reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(float) / 2**23
        else:
            x = raw.view(f"<i{width}").astype(float) / 2 ** (self.bits - 1)
        return x.reshape(stop - start, self.channels)


def layout_of(data: bytes) -> Layout:
    """Layout of a WAV file of 8/16/24/32-bit PCM or 32/64-bit float; ValueError for any other."""
    chunks = _chunks(data)
    if b"fmt " not in chunks or b"data" not in chunks:
        raise ValueError("missing_chunk")
    fmt, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, chunks[b"fmt "][0])
    if fmt == 0xFFFE and chunks[b"fmt "][1] >= 26:
        fmt = struct.unpack_from("<H", data, chunks[b"fmt "][0] + 24)[0]
    at, size = chunks[b"data"]
    width = bits // 8
    if channels < 1 or width < 1 or (fmt, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError("unsupported_encoding")
    return Layout(rate, channels, fmt, bits, at, size // (width * channels))


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples x channels in [-1, 1]) of a whole file."""
    layout = layout_of(data)
    return layout.rate, layout.samples(data, 0, layout.n)


#: Rows that a decoding task holds before it passes them on.
HELD_BLOCKS = 256


def _decoded(recordings: DataFrame, block_len: int, key: str, channel: bool, max_seconds: float | None) -> DataFrame:
    """One row per block and channel, or per block with the mean of its channels; blocks are decoded as they are passed on."""

    def rows_of(k, content) -> Iterator[list]:
        data = b"" if content is None else bytes(content)
        try:
            layout = layout_of(data)
            error = None if layout.n else "empty"
        except (ValueError, struct.error) as e:
            layout, error = None, str(e) or "malformed"
        if error is not None:
            yield [k, None, None, None, layout and layout.rate, None, None, error]
            return
        end = layout.n if max_seconds is None else min(layout.n, math.ceil(layout.rate * max_seconds))
        for start in range(0, end, block_len):
            x = layout.samples(data, start, min(start + block_len, end))
            if channel:
                for ch in range(layout.channels):
                    yield [k, ch, start // block_len, start, layout.rate, x[:, ch], layout.n, None]
            else:  # channel by channel, so that the sum does not depend on how numpy groups it
                mean = sum(x[:, ch] for ch in range(layout.channels)) / layout.channels
                yield [k, layout.channels, start // block_len, start, layout.rate, mean, layout.n, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[list] = []
        for pdf in batches:
            for k, content in zip(pdf[key], pdf["content"]):
                for row in rows_of(k, content):
                    rows.append(row)
                    if len(rows) == HELD_BLOCKS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    second = "channel" if channel else "channels"
    names = [key, second, "block_id", "start", "sr", "xs", "n_clip", "error"]
    kt = recordings.schema[key].dataType.simpleString()
    schema = f"{key} {kt}, {second} int, block_id bigint, start bigint, sr int, xs array<double>, n_clip bigint, error string"
    return recordings.select(key, "content").mapInPandas(run, schema)


def pcm_blocks(recordings: DataFrame, block_len: int = BLOCK, key: str = "clip_id") -> DataFrame:
    """Recordings to rows of at most ``block_len`` samples per channel.

    A recording that cannot be decoded becomes one row with ``error``.
    """
    return _decoded(recordings, block_len, key, channel=True, max_seconds=None)


def mono_blocks(recordings: DataFrame, block_len: int = BLOCK, key: str = "clip_id", max_seconds: float | None = None) -> DataFrame:
    """Recordings to blocks of the mean of their channels, with ``channels``; errors as in ``pcm_blocks``.

    Decoding, downmix and cut happen in the task that reads the file, so samples
    cross no shuffle, and a task holds the bytes of one file and HELD_BLOCKS blocks.
    """
    return _decoded(recordings, block_len, key, channel=False, max_seconds=max_seconds)


def downmix_blocks(blocks: DataFrame, key: str = "clip_id") -> DataFrame:
    """Mean over channels, block by block (a handful of rows per key)."""
    d = blocks.where("error IS NULL").groupBy(key, "block_id").agg(
        F.count(F.lit(1)).alias("channels"), F.collect_list("xs").alias("all"), F.max("start").alias("start"), F.max("sr").alias("sr"),
        F.max("n_clip").alias("n_clip"),
    )
    mean = F.expr(
        "transform(all[0], (x, i) -> aggregate(all, 0D, (s, c) -> s + c[i]) / channels)"
    )
    return d.select(key, "block_id", "start", "sr", "n_clip", "channels", F.when(F.col("channels") == 1, F.col("all")[0]).otherwise(mean).alias("xs"))


def cap_blocks(blocks: DataFrame, max_seconds: float) -> DataFrame:
    """Samples before ``max_seconds``; whole blocks are dropped without touching the rest."""
    top = F.col("sr") * max_seconds
    return (
        blocks.where(F.col("start") < top)
        .withColumn("xs", F.slice("xs", F.lit(1), F.least(F.size("xs"), (top - F.col("start")).cast("int"))))
    )


def encode_wav(chunks: DataFrame, sr: int = K.SAMPLE_RATE, key: str = "clip_id") -> DataFrame:
    """Rows ``(key, xs)`` to 16-bit mono WAV bytes in ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for xs in pdf["xs"]:
                body = np.clip(np.rint(np.asarray(xs, dtype=float) * 32768.0), -32768, 32767).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, sr, sr * 2, 2, 16, b"data", len(body))
                out.append(head + body)
            yield pd.DataFrame({key: pdf[key], "content": out})

    kt = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "xs").mapInPandas(run, f"{key} {kt}, content binary")
