"""Cepstra, band contrast, linear prediction and pitch of ready-made frame rows.

Everything but the pitch is array functions on one row: constant matrices are
literals, the prediction is a fold.  Frames are bounded rows, so nothing here
depends on how long a clip is; what needs the clip is one maximum per clip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.functions import signal as sig
from voxledger.functions.ordered import SEG
from voxledger.functions.vectors import dot

CLIP = ["clip_id"]
FLOOR_DB = 80.0


def _matrix(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def _decibel(power: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(F.lit(sig.AMIN), power))


def _floored(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Raise array columns to FLOOR_DB below the clip's largest value; ``levels`` names the columns and their maxima."""
    tops = df.groupBy("clip_id").agg(*[F.max(F.array_max(c)).alias(top) for c, top in levels.items()])

    def raised(c: str, top: str) -> Column:
        return F.transform(c, lambda x: F.greatest(x, F.col(top) - F.lit(FLOOR_DB)))

    return df.join(tops, CLIP).withColumns({c: raised(c, top) for c, top in levels.items()}).drop(*levels.values())


def mel_cepstra(spectra: DataFrame, sr: int, n_fft: int, n_mels: int, n_out: int) -> DataFrame:
    """Add ``mfcc`` to rows with ``mag``: mel triangles, dB at most 80 below the clip's loudest band, cosine basis."""
    power = F.transform("mag", lambda m: m * m)
    triangles, basis = _matrix(sig.mel_weights(sr, n_fft, n_mels)), _matrix(sig.cosine_basis(n_out, n_mels))
    mel = F.transform(triangles, lambda row: _decibel(dot(row, F.col("_power"))))
    d = spectra.withColumn("_power", power).withColumn("_mel", mel).drop("_power")
    d = _floored(d, {"_mel": "_top"})
    return d.withColumn("mfcc", F.transform(basis, lambda row: dot(row, F.col("_mel")))).drop("_mel")


def band_contrast(spectra: DataFrame, freqs: np.ndarray, low: float = 200.0, bands: int = 6, quantile: float = 0.02) -> DataFrame:
    """Add ``peaks`` and ``valleys`` (dB per octave band) and ``contrast``, the mean of their differences."""

    def level(first: int, stop: int, k: int, strongest: bool) -> Column:
        part = F.sort_array(F.slice("mag", first + 1, stop - first), asc=not strongest)
        return _decibel(F.aggregate(F.slice(part, 1, k), F.lit(0.0), lambda s, x: s + x) / F.lit(float(k)))

    cuts = sig.octave_bands(freqs, low, bands, quantile)
    d = spectra.withColumn("peaks", F.array(*[level(*c, True) for c in cuts])).withColumn("valleys", F.array(*[level(*c, False) for c in cuts]))
    d = _floored(d, {"peaks": "_peak", "valleys": "_valley"})
    apart = F.aggregate(F.zip_with("peaks", "valleys", lambda p, v: p - v), F.lit(0.0), lambda s, x: s + x)
    return d.withColumn("contrast", apart / F.lit(float(len(cuts))))


def linear_prediction(frames: DataFrame, n: int, order: int, emphasis: float = 0.97) -> DataFrame:
    """Add ``lpc``, the prediction polynomial (1, a1 .. a_order) of frames of ``n`` samples, by Levinson and Durbin's recursion.

    Frames are pre-emphasised and Hann-windowed.  The recursion folds over the
    order with the polynomial and the error left; a frame without energy, or
    whose error is used up, keeps the polynomial that it has, padded with zeros.
    """
    window = ", ".join(f"{w!r}D" for w in np.hanning(n).tolist())
    d = frames.withColumn("_w", F.expr(f"array({window})")).withColumn(
        "_x", F.expr(f"transform(xs, (x, i) -> (CAST(x AS DOUBLE) - if(i = 0, 0D, {emphasis}D * xs[i - 1])) * _w[i])")
    )
    d = d.withColumn(
        "_r", F.expr(f"transform(sequence(0, {order}), k -> aggregate(zip_with(_x, slice(_x, k + 1, {n}), (a, b) -> coalesce(a * b, 0D)), 0D, (s, x) -> s + x))")
    )
    # reflection = -(sum of a[j] * r[i - j]) / error
    reflection = "-aggregate(transform(acc.a, (a, j) -> a * _r[i - j]), 0D, (s, x) -> s + x) / acc.e"
    grown = "transform(sequence(0, i), j -> if(j < i, acc.a[j], 0D) + if(j > 0, k * acc.a[i - j], 0D))"
    still = "named_struct('a', concat(acc.a, array(0D)), 'e', acc.e)"
    step = f"if(acc.e > 0D, transform(array({reflection}), k -> named_struct('a', {grown}, 'e', acc.e * (1D - k * k)))[0], {still})"
    fold = f"aggregate(sequence(1, {order}), named_struct('a', array(1D), 'e', _r[0]), (acc, i) -> {step}, acc -> acc.a)"
    return d.withColumn("lpc", F.expr(fold)).drop("_w", "_x", "_r")


def resonances(polynomials: DataFrame, sr: int, count: int = 4) -> DataFrame:
    """f1 .. f_count of rows with ``lpc``; rows with fewer resonances are dropped.  Only polynomials go to Python."""
    names = [f"f{i + 1}" for i in range(count)]

    def run(batches):
        for pdf in batches:
            found = sig.resonances(np.stack(pdf["lpc"].to_list()), sr, count) if len(pdf) else np.zeros((0, count))
            keep = ~np.isnan(found).any(axis=1)
            yield pdf.loc[keep, ["clip_id", "frame_id"]].reset_index(drop=True).assign(**{n: found[keep, i] for i, n in enumerate(names)})

    kinds = ", ".join(f"{c} {polynomials.schema[c].dataType.simpleString()}" for c in ("clip_id", "frame_id"))
    return polynomials.select("clip_id", "frame_id", "lpc").mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def pitch_of(frames: DataFrame, sr: int, fmin: float, fmax: float, threshold: float = 0.1, voiced_below: float = 0.2) -> DataFrame:
    """YIN of frame rows of one length: ``lag`` of the chosen dip, ``dip`` (aperiodicity), ``f0`` between samples, ``voiced``."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["xs"].to_list()).astype(float)
            lag, shift, dip = sig.yin_dips(x, *sig.lag_range(x.shape[1], sr, fmin, fmax), threshold)
            f0 = sr / (lag + shift)
            voiced = (dip < voiced_below) & (f0 >= fmin) & (f0 <= fmax) & ((x**2).sum(axis=1) > 0)
            yield pd.DataFrame({"clip_id": pdf["clip_id"], "frame_id": pdf["frame_id"], SEG: pdf[SEG], "lag": lag, "dip": dip, "f0": f0, "voiced": voiced})

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("clip_id", "frame_id", SEG))
    return frames.select("clip_id", "frame_id", SEG, "xs").mapInPandas(run, f"{kinds}, lag int, dip double, f0 double, voiced boolean")
