"""Frame feature jobs: Arrow batches in, compact frame rows out.

Each job maps rows to rows; a clip reaches it as blocks with a little context
from their neighbours (or as scan windows), never as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import constants as K
from voxledger.functions import signal as sig
from voxledger.functions.numbers import round_dp
from voxledger.functions.ordered import SEG, attach, ordered, seg_of, with_segments

CLIP = ["clip_id"]
N_FFT = 2048


def _map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):  # bounds the memory of one step
                yield fn(pdf.iloc[lo : lo + 64])

    return df.mapInPandas(run, schema)


def _key(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def spectra_of(frames: DataFrame, n_fft: int) -> DataFrame:
    """Hann magnitude and phase of frame rows with ``n_fft`` samples."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        spec = sig.spectrum(np.stack(pdf["xs"].to_list()))
        return pd.DataFrame(
            {
                "clip_id": pdf["clip_id"], "frame_id": pdf["frame_id"], SEG: pdf[SEG],
                "mag": list(np.abs(spec)), "phase": list(sig.phase_of(spec)),
            }
        )

    schema = f"{_key(frames, 'clip_id', 'frame_id', SEG)}, mag array<double>, phase array<double>"
    return _map(frames.select("clip_id", "frame_id", SEG, "xs"), fn, schema)


def spectral_shape(spectra: DataFrame, hz_per_bin: float, share: float = 0.85) -> DataFrame:
    """Centroid, bandwidth and rolloff of magnitude arrays, with array functions only."""
    d = spectra.withColumns(
        {
            "_m": F.expr("aggregate(mag, 0D, (s, x) -> s + x)"),
            "_fm": F.expr(f"aggregate(transform(mag, (x, i) -> x * i * {hz_per_bin}D), 0D, (s, x) -> s + x)"),
        }
    ).withColumn("centroid", F.expr("coalesce(_fm / nullif(_m, 0D), 0D)"))
    spread = f"aggregate(transform(mag, (x, i) -> x * power(i * {hz_per_bin}D - centroid, 2)), 0D, (s, x) -> s + x)"
    # running sum carried as (sum so far, bins below the share)
    below = (
        "aggregate(mag, named_struct('s', 0D, 'n', 0), (a, x) -> named_struct('s', a.s + x, "
        f"'n', a.n + if(a.s + x < {share}D * _m, 1, 0))).n"
    )
    return d.withColumns(
        {
            "bandwidth": F.expr(f"sqrt(coalesce({spread} / nullif(_m, 0D), 0D))"),
            "rolloff": F.expr(f"{below} * {hz_per_bin}D"),
        }
    ).drop("_m", "_fm")


def with_context(blocks: DataFrame, reach: int) -> DataFrame:
    """Give each block the last ``reach`` samples before it and the first ``reach`` after it.

    Keyed by ``(clip_id, block_id)``: three rows per key, whatever the clip.
    ``last_block`` marks the end of a clip.
    """
    arr = "array<double>"
    null = F.lit(None).cast(arr)
    xs = F.col("xs").cast(arr)
    b = F.col("block_id")
    parts = F.array(
        F.struct(b.alias("block_id"), xs.alias("own"), null.alias("left"), null.alias("right")),
        F.struct((b + 1).alias("block_id"), null.alias("own"), F.slice(xs, F.greatest(F.lit(1), F.size("xs") - reach + 1), F.lit(reach)).alias("left"), null.alias("right")),
        F.struct((b - 1).alias("block_id"), null.alias("own"), null.alias("left"), F.slice(xs, 1, reach).alias("right")),
    )
    d = blocks.select("clip_id", SEG, F.inline(parts)).groupBy("clip_id", "block_id").agg(
        *[F.first(c, True).alias(c) for c in ("own", "left", "right")], seg_of(blocks, F.max)
    )
    empty = F.array().cast(arr)
    return d.where("own IS NOT NULL").select(
        "clip_id", "block_id", SEG, "own", F.coalesce("left", empty).alias("left"), F.coalesce("right", empty).alias("right"),
        F.col("right").isNull().alias("last_block"),
    )


def _block_frames(row, block_len: int, n: int, hop: int, extra: int = 0) -> tuple[int, np.ndarray]:
    """(first frame id, centred frames) of a block row, ``extra`` frames before it included."""
    start = row.block_id * block_len
    stop = start + len(row.own) + (1 if row.last_block else 0)
    t0, t1 = -(-start // hop), -(-stop // hop)
    first = max(0, t0 - extra)
    left = np.asarray(row.left, dtype=float)
    x = np.concatenate([np.zeros(n // 2 + (extra + 1) * hop), left, np.asarray(row.own, dtype=float), np.asarray(row.right, dtype=float)])
    zero = n // 2 + (extra + 1) * hop + len(left) - start  # position of sample 0 in x
    offset = zero + first * hop - n // 2
    return t0, sig.framed(x, offset, max(0, t1 - first), n, hop) if t1 > first else np.zeros((0, n))


def _spectral_parts(frames: np.ndarray):
    mag = np.abs(sig.spectrum(frames))
    freqs = np.fft.rfftfreq(N_FFT, 1.0 / K.SAMPLE_RATE)
    mel = sig.db(mag**2 @ sig.mel_weights(K.SAMPLE_RATE, N_FFT, 128).T)
    peak, valley = sig.contrast_levels(mag, freqs)
    return mag, freqs, mel, peak, valley


def _rise(mel: np.ndarray, step: int) -> np.ndarray:
    """Mean rise over ``step`` frames; zero where there is no earlier frame."""
    up = np.maximum(0.0, mel[step:] - mel[:-step]).mean(axis=1)
    return np.concatenate([np.zeros(min(step, len(mel))), up])


def clip_levels(context: DataFrame, block_len: int) -> DataFrame:
    """Largest spectrogram, mel, peak and valley level of each clip (dB), for the 80 dB floors."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            _, fr = _block_frames(r, block_len, N_FFT, K.HOP)
            if len(fr):
                mag, _, mel, peak, valley = _spectral_parts(fr)
                rows.append((r.clip_id, getattr(r, SEG), float(sig.db(mag**2).max()), float(mel.max()), float(peak.max()), float(valley.max())))
        return pd.DataFrame(rows, columns=["clip_id", SEG, "top_mag", "top_mel", "top_peak", "top_valley"])

    schema = f"{_key(context, 'clip_id', SEG)}, top_mag double, top_mel double, top_peak double, top_valley double"
    levels = _map(context, fn, schema)
    return levels.groupBy("clip_id").agg(
        *[F.max(c).alias(c) for c in ("top_mag", "top_mel", "top_peak", "top_valley")], seg_of(context, F.max)
    )


def frame_features(context: DataFrame, levels: DataFrame, block_len: int) -> DataFrame:
    """Per hop-256 frame: MFCC, spectral shape, contrast, level and onset strength."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            t0, fr = _block_frames(r, block_len, N_FFT, K.HOP, extra=2)
            if not len(fr):
                continue
            mag, freqs, mel, peak, valley = _spectral_parts(fr)
            mel = np.maximum(mel, r.top_mel - 80.0)
            lead = len(fr) - _own_count(r, block_len, K.HOP)  # frames before the block's own
            onset, onset2 = (_rise(mel, step)[lead:] for step in (1, 2))
            mag, mel, peak, valley = (a[lead:] for a in (mag, mel, peak, valley))
            centroid, bandwidth, roll85, roll95 = sig.shape(mag, freqs, (0.85, 0.95))
            contrast = (np.maximum(peak, r.top_peak - 80.0) - np.maximum(valley, r.top_valley - 80.0)).mean(axis=1)
            level = np.maximum(sig.db(mag**2), r.top_mag - 80.0).mean(axis=1)
            _, short = _block_frames(r, block_len, 512, K.HOP)
            rms = np.sqrt((short**2).mean(axis=1))
            k = len(mag)
            out.append(
                pd.DataFrame(
                    {
                        "clip_id": r.clip_id, "frame_id": np.arange(t0, t0 + k), SEG: getattr(r, SEG),
                        "mfcc": list(sig.cepstrum(mel, K.N_MFCC)), "centroid": centroid, "bandwidth": bandwidth,
                        "rolloff": roll85, "rolloff95": roll95, "contrast": contrast, "mean_db": level, "rms": rms,
                        "onset": onset, "onset2": onset2,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    names = ["clip_id", "frame_id", SEG, "mfcc", "centroid", "bandwidth", "rolloff", "rolloff95", "contrast", "mean_db", "rms", "onset", "onset2"]
    scalars = ", ".join(f"{n} double" for n in names[4:])
    schema = f"{_key(context, 'clip_id')}, frame_id bigint, {SEG} int, mfcc array<double>, {scalars}"
    return _map(attach(context, levels, CLIP), fn, schema)


def _own_count(row, block_len: int, hop: int) -> int:
    start = row.block_id * block_len
    stop = start + len(row.own) + (1 if row.last_block else 0)
    return -(-stop // hop) - -(-start // hop)


def pitch_frames(
    context: DataFrame, block_len: int, hop: int = K.HOP, fmin: float = 60.0, fmax: float = 500.0,
    frame: int = 2048, voiced_below: float = 0.2,
) -> DataFrame:
    """YIN pitch per centred frame; voiced where the aperiodicity is low and f0 in range."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            t0, fr = _block_frames(r, block_len, frame, hop)
            if len(fr):
                f0, ap = sig.yin(fr, K.SAMPLE_RATE, fmin, fmax)
                ok = (ap < voiced_below) & (f0 >= fmin) & (f0 <= fmax) & ((fr**2).sum(axis=1) > 0)
                out.append(
                    pd.DataFrame(
                        {
                            "clip_id": r.clip_id, "frame_id": np.arange(t0, t0 + len(fr)), SEG: getattr(r, SEG),
                            "f0": np.where(ok, f0, np.nan), "voiced": ok, "f0_any": f0,
                        }
                    )
                )
        return pd.concat(out) if out else pd.DataFrame(columns=["clip_id", "frame_id", SEG, "f0", "voiced", "f0_any"])

    schema = f"{_key(context, 'clip_id')}, frame_id bigint, {SEG} int, f0 double, voiced boolean, f0_any double"
    return _map(context, fn, schema).withColumn("f0", F.when(F.col("voiced"), F.col("f0")))


def formant_frames(frames: DataFrame, pframes: DataFrame, sr: int = K.SAMPLE_RATE) -> DataFrame:
    """F1..F4 of the voiced frames; frames without four resonances are dropped."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sig.formants(np.stack(pdf["xs"].to_list()), sr, order=sr // 1000 + 2)
        keep = ~np.isnan(found[:, 0])
        out = pdf.loc[keep, ["clip_id", "frame_id", SEG]].reset_index(drop=True)
        return out.assign(**{f"f{i + 1}": found[keep, i] for i in range(4)})

    voiced = frames.join(pframes.where("voiced").select("clip_id", "frame_id"), ["clip_id", "frame_id"], "left_semi")
    schema = f"{_key(frames, 'clip_id', 'frame_id', SEG)}, f1 double, f2 double, f3 double, f4 double"
    return _map(voiced.select("clip_id", "frame_id", SEG, "xs"), fn, schema)


def window_frames(windows: DataFrame, voiced_below: float = 0.2) -> DataFrame:
    """Scan windows ``(clip_id, window_id, xs)`` to one row each with its frames and phase variance.

    The window is transformed on its own, zero outside, so that frames at its
    edges see no neighbouring sound.  A window whose transforms fail, by whatever
    its samples hold, has no frames and says why in ``error``; the job goes on.
    """
    first = int(K.HF_BAND_HZ * 1024 // K.SAMPLE_RATE) + 1

    def one(x: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        mag = np.abs(sig.spectrum(sig.centred(x, 1024, K.HOP)))
        wide = np.abs(sig.spectrum(sig.centred(x, N_FFT, K.HOP)))
        freqs = np.fft.rfftfreq(N_FFT, 1.0 / K.SAMPLE_RATE)
        mel = sig.db(wide**2 @ sig.mel_weights(K.SAMPLE_RATE, N_FFT, 128).T)
        mfcc = sig.cepstrum(np.maximum(mel, mel.max() - 80.0), K.N_MFCC)
        centroid = sig.shape(wide, freqs, ())[0]
        rms = np.sqrt((sig.centred(x, 512, K.HOP) ** 2).mean(axis=1))
        voice = sig.centred(x, 2048, K.HOP)
        f0, ap = sig.yin(voice, K.SAMPLE_RATE, 60.0, 500.0)
        ok = (ap < voiced_below) & (f0 >= 60) & (f0 <= 500) & ((voice**2).sum(axis=1) > 0)
        phase = np.diff(sig.phase_of(sig.spectrum(sig.centred(x, 512, 128))), axis=0)
        hf = mag[:, first:]
        fields = {
            "frame_id": np.arange(len(mag)), "hf_step": np.abs(np.diff(hf, axis=1)).mean(axis=1), "hf_mean": hf.mean(axis=1),
            "mag_max": mag.max(axis=1), "mag_median": np.median(mag, axis=1), "centroid": centroid, "rms": rms,
            "mfcc": list(mfcc), "f0": np.where(ok, f0, np.nan), "voiced": ok,
        }
        return fields, float(phase.var())

    def tried(x) -> tuple[dict, float | None, str | None]:
        try:
            samples = np.asarray(x, dtype=float)
            if samples.ndim != 1 or not len(samples) or not np.isfinite(samples).all():
                raise ValueError("window without finite samples")
            return *one(samples), None
        except (ValueError, ArithmeticError, IndexError, TypeError, np.linalg.LinAlgError) as failed:
            return {n: [] for n in kinds}, None, f"{type(failed).__name__}: {failed}"

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        done = [tried(x) for x in pdf["xs"]]
        out = pdf.drop(columns="xs").assign(phase_var=[d[1] for d in done], error=[d[2] for d in done])
        return out.assign(**{n: [d[0][n] for d in done] for n in kinds})

    keep = [c for c in windows.columns if c != "xs"]
    kinds = {
        "frame_id": "bigint", "hf_step": "double", "hf_mean": "double", "mag_max": "double", "mag_median": "double",
        "centroid": "double", "rms": "double", "mfcc": "array<double>", "f0": "double", "voiced": "boolean",
    }
    schema = f"{_key(windows, *keep)}, phase_var double, error string, " + ", ".join(f"{n} array<{k}>" for n, k in kinds.items())
    fields = F.transform("f0", lambda v: F.nullif(v, F.lit(float("nan")))).alias("f0")
    zipped = F.arrays_zip(*[fields if n == "f0" else F.col(n) for n in kinds]).alias("frames")
    return _map(windows.select(*keep, "xs"), fn, schema).select(*keep, zipped, "phase_var", "error")


# peak picking in frames at hop 256 (30 ms before, 100 ms around): a frame is an
# onset when it is the largest of itself and PRE_MAX before, and stands DELTA above
# the mean of AVG frames on both sides
PRE_MAX, AVG, DELTA = 1, 6, 0.07


def onset_envelope(features: DataFrame, shift: int = N_FFT // (2 * K.HOP), strength: str = "onset") -> DataFrame:
    """Onset strength delayed by ``shift`` frames, zero before, as long as the clip: ``(clip_id, frame_id, o)``."""
    d = ordered(
        with_segments(features.select("clip_id", "frame_id", F.col(strength).alias("o"), SEG), CLIP, "frame_id"),
        CLIP, ["frame_id"], totals={"_n": ("sum", F.lit(1))},
    )
    at = F.when(F.col("frame_id") == 0, F.sequence(F.lit(0).cast("long"), F.lit(shift).cast("long"))).otherwise(
        F.array(F.col("frame_id") + shift)
    )
    return (
        d.withColumn("frame_id", F.explode(at))
        .where("frame_id < _n")
        .select("clip_id", "frame_id", F.when(F.col("frame_id") <= shift, 0.0).otherwise(F.col("o")).alias("o"), SEG)
    )


def onsets(envelope: DataFrame, reach: int = 512) -> DataFrame:
    """Onset frames by local maximum over local mean, no two of them adjacent.

    A clip is cut into stretches of ``reach`` frames that overlap by the widest
    surrounding, so nothing depends on its length.  Of adjacent candidates every
    second one stays, counted from the first.
    """
    d = ordered(envelope, CLIP, ["frame_id"], totals={"_lo": ("min", "o"), "_hi": ("max", "o")})
    d = d.withColumn("v", F.expr("coalesce((o - _lo) / nullif(_hi - _lo, 0D), 0D)"))
    at = F.col("frame_id")
    first, last = F.greatest(F.lit(0), F.floor((at - AVG) / reach)), F.floor((at + AVG) / reach)
    d = d.withColumn("stretch", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("clip_id", "stretch").orderBy("frame_id")
    d = d.select(
        "*", F.max("v").over(w.rowsBetween(-PRE_MAX, 0)).alias("top"), F.avg("v").over(w.rowsBetween(-AVG, AVG)).alias("mean")
    ).where(f"floor(frame_id / {reach}) = stretch AND v > 0 AND v = top AND v >= mean + {DELTA}D")
    d = ordered(d.select("clip_id", "frame_id", SEG), CLIP, ["frame_id"], previous={"_p": "frame_id"})
    d = d.withColumn("_new", F.expr("if(_p = frame_id - 1, NULL, frame_id)"))
    d = ordered(d, CLIP, ["frame_id"], maxes={"_run": "_new"})
    return d.where("(frame_id - coalesce(_new, _run)) % 2 = 0").select("clip_id", "frame_id", SEG)


def score_with(df: DataFrame, scores: DataFrame, keys: list[str], out: str = "model", baseline: float = 50.0) -> DataFrame:
    """Attach a model's score (0..100, one decimal); a missing one is the baseline."""
    d = df.join(scores.select(*keys, F.col("score").cast("double").alias("_s")), keys, "left")
    rounded = round_dp(F.coalesce("_s", F.lit(float(baseline))), 1)
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded))).drop("_s")


def predict_scores(df: DataFrame, vector: str, size: int, make_predict: Callable, batch_size: int = 64) -> Column:
    """Column scored by a user model on vectors of ``size`` numbers; the model is loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf

    kind = df.schema[vector].dataType.elementType
    udf = predict_batch_udf(make_predict, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[size]])
    return udf(F.col(vector))
