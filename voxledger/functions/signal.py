"""Numpy arithmetic on one short stretch of samples, used inside Arrow tasks.

Frames are centred: frame t is centred on sample t*hop of a stretch that is
zero outside.  Textbook definitions of the short-time spectrum, mel cepstrum,
spectral contrast, YIN pitch and linear prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

AMIN = 1e-10


@lru_cache(maxsize=8)
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def framed(padded: np.ndarray, first: int, count: int, n: int, hop: int) -> np.ndarray:
    """``count`` frames of ``n`` samples every ``hop`` from offset ``first``, zero beyond the end."""
    need = first + (count - 1) * hop + n
    if need > len(padded):
        padded = np.concatenate([padded, np.zeros(need - len(padded))])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[first : first + (count - 1) * hop + 1 : hop]


def centred(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    """All centred frames of a whole stretch."""
    return framed(np.concatenate([np.zeros(n // 2), x]), 0, 1 + len(x) // hop, n, hop)


def spectrum(frames: np.ndarray) -> np.ndarray:
    return np.fft.rfft(frames * hann(frames.shape[1]), axis=1)


def phase_of(spec: np.ndarray) -> np.ndarray:
    """Phase with the sign of zero removed, so that a real bin is 0 or pi."""
    return np.arctan2(spec.imag + 0.0, spec.real)


def db(power: np.ndarray) -> np.ndarray:
    return 10.0 * np.log10(np.maximum(AMIN, power))


@lru_cache(maxsize=4)
def mel_weights(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Area-normalised triangles on the linear-below-1-kHz mel scale."""
    step, knee = 200.0 / 3, 1000.0
    log_step = np.log(6.4) / 27.0

    def to_hz(m):
        return np.where(m < knee / step, m * step, knee * np.exp(log_step * (m - knee / step)))

    top = knee / step + np.log(sr / 2 / knee) / log_step
    edges = to_hz(np.linspace(0.0, top, n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1.0 / sr)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=4)
def cosine_basis(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal type-II cosine basis."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    return basis


def cepstrum(mel_db: np.ndarray, n_out: int) -> np.ndarray:
    return mel_db @ cosine_basis(n_out, mel_db.shape[1]).T


def shape(mag: np.ndarray, freqs: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Centroid, bandwidth and one rolloff frequency per share; zero for a silent frame."""
    total = mag.sum(axis=1)
    p = mag / np.where(total > 0, total, 1.0)[:, None]
    centroid = p @ freqs
    bandwidth = np.sqrt((p * (freqs[None] - centroid[:, None]) ** 2).sum(axis=1))
    cum = np.cumsum(mag, axis=1)
    rolls = [freqs[np.argmax(cum >= s * cum[:, -1:], axis=1)] for s in shares]
    return [centroid, bandwidth, *rolls]


def octave_bands(freqs: np.ndarray, low: float = 200.0, bands: int = 6, quantile: float = 0.02) -> list[tuple[int, int, int]]:
    """(first bin, one past the last, bins counted as strongest or weakest) of the band below ``low`` and those above, each twice as high."""
    edges = [0.0] + [low * 2**i for i in range(bands + 1)]
    out = []
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        bins, top = np.flatnonzero((freqs >= lo) & (freqs <= hi)), b == bands
        first, last = int(bins[0]) - (b > 0), (len(freqs) if top else int(bins[-1]) + 1)
        out.append((first, last - (not top), max(1, int(np.rint(quantile * (last - first))))))
    return out


def contrast_levels(mag: np.ndarray, freqs: np.ndarray, quantile: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the strongest and weakest bins per octave band (below 200 Hz, then doubling), in dB."""
    peaks, valleys = [], []
    for first, stop, k in octave_bands(freqs, quantile=quantile):
        band = np.sort(mag[:, first:stop], axis=1)
        peaks.append(band[:, -k:].mean(axis=1))
        valleys.append(band[:, :k].mean(axis=1))
    return db(np.stack(peaks, axis=1)), db(np.stack(valleys, axis=1))


def lag_range(n: int, sr: int, fmin: float, fmax: float) -> tuple[int, int]:
    """Smallest and largest lag searched in frames of n samples."""
    return max(2, int(sr / fmax)), min(int(np.ceil(sr / fmin)), n // 2 - 1)


def yin_dips(frames: np.ndarray, lag_lo: int, lag_hi: int, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, parabolic shift, dip) per frame: cumulative-mean-normalised difference, its first dip below the threshold or its minimum."""
    n = frames.shape[1]
    w = n // 2
    size = 2 * n
    head = np.fft.rfft(frames[:, :w], size, axis=1)
    acf = np.fft.irfft(np.conj(head) * np.fft.rfft(frames, size, axis=1), size, axis=1)[:, : lag_hi + 2]
    sq = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    lags = np.arange(lag_hi + 2)
    energy = sq[:, lags + w] - sq[:, lags]
    diff = np.maximum(energy[:, :1] + energy - 2 * acf, 0.0)
    norm = np.ones_like(diff)
    norm[:, 1:] = diff[:, 1:] * lags[1:] / np.maximum(np.cumsum(diff[:, 1:], axis=1), 1e-12)
    inner = norm[:, lag_lo : lag_hi + 1]
    low = (inner <= norm[:, lag_lo - 1 : lag_hi]) & (inner < norm[:, lag_lo + 1 : lag_hi + 2])
    good = low & (inner < threshold)
    at = np.where(good.any(axis=1), good.argmax(axis=1), inner.argmin(axis=1)) + lag_lo
    row = np.arange(len(frames))
    a, b, c = norm[row, at - 1], norm[row, at], norm[row, at + 1]
    bend = a - 2 * b + c
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(bend == 0, 1.0, bend), 0.0)
    return at, np.clip(shift, -1, 1), b


def yin(frames: np.ndarray, sr: int, fmin: float, fmax: float, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(f0, aperiodicity) per frame."""
    lag, shift, dip = yin_dips(frames, *lag_range(frames.shape[1], sr, fmin, fmax), threshold)
    return sr / (lag + shift), dip


def predictors(frames: np.ndarray, order: int) -> np.ndarray:
    """Linear-prediction polynomials (1, a1 .. a_order) of pre-emphasised, windowed frames.

    All normal equations are solved at once; frames without energy, or whose
    equations have no answer, get the polynomial 1.
    """
    x = np.concatenate([frames[:, :1], frames[:, 1:] - 0.97 * frames[:, :-1]], axis=1)
    x = x * np.hanning(x.shape[1])
    size = 2 ** int(np.ceil(np.log2(2 * x.shape[1])))
    acf = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, size, axis=1)[:, : order + 1]
    live = (x**2).sum(axis=1) > 0
    acf[~live] = np.eye(1, order + 1)
    toeplitz = acf[:, np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
    live &= np.linalg.slogdet(toeplitz)[0] > 0
    toeplitz[~live] = np.eye(order)
    a = np.linalg.solve(toeplitz, -acf[:, 1:, None])[:, :, 0]
    return np.concatenate([np.ones((len(a), 1)), np.where(live[:, None], a, 0.0)], axis=1)


def resonances(poly: np.ndarray, sr: int, count: int = 4) -> np.ndarray:
    """(rows, count): the lowest resonances of prediction polynomials; NaN in rows that have fewer.

    Resonances are eigenvalues of companion matrices inside the unit circle and
    above the real axis, between 50 and 5000 Hz.
    """
    order = poly.shape[1] - 1
    companion = np.zeros((len(poly), order, order))
    companion[:, 0] = -poly[:, 1:]
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1.0
    z = np.linalg.eigvals(companion) if len(poly) else np.zeros((0, order), dtype=complex)
    hz = np.angle(z) * sr / (2 * np.pi)
    hz = np.sort(np.where((np.abs(z) < 1.0) & (z.imag > 0) & (hz > 50) & (hz < 5000), hz, np.nan), axis=1)[:, :count]
    return np.where(np.isnan(hz).any(axis=1, keepdims=True), np.nan, np.round(hz, 1))


def formants(frames: np.ndarray, sr: int, order: int, count: int = 4) -> np.ndarray:
    """(frames, count): the lowest resonances by linear prediction; NaN in rows that have fewer."""
    return resonances(predictors(frames, order), sr, count)
