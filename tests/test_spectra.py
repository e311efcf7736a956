"""Array operators against the numpy definitions, and resonances of polynomials with known roots."""

import numpy as np
import pytest

from voxledger.functions import signal as sig
from voxledger.operators import spectra as SP

RNG = np.random.default_rng(4)


def frames(spark, x):
    return spark.createDataFrame([("a", i, [float(v) for v in row], 0) for i, row in enumerate(x)], "clip_id string, frame_id long, xs array<double>, seg int")


def test_prediction_matches_solved_equations(spark):
    x = RNG.normal(size=(20, 64))
    x[3] = 0
    got = SP.linear_prediction(frames(spark, x), 64, 6).orderBy("frame_id").toPandas()["lpc"]
    np.testing.assert_allclose(np.stack(got.to_list()), sig.predictors(x, 6), atol=1e-9)


def test_resonances_of_known_roots(spark):
    hz = [[500.0, 1500.0, 2500.0, 3500.0], [320.0, 900.0, 2200.0, 4100.0]]
    poly = [np.poly([z for f in row for z in (0.97 * np.exp(2j * np.pi * f / 16000), 0.97 * np.exp(-2j * np.pi * f / 16000))]).real for row in hz]
    poly.append(np.eye(1, 9)[0])  # no resonance at all: the row is dropped
    df = spark.createDataFrame([("a", i, [float(v) for v in p]) for i, p in enumerate(poly)], "clip_id string, frame_id long, lpc array<double>")
    got = SP.resonances(df, 16000).orderBy("frame_id").collect()
    np.testing.assert_allclose([[r.f1, r.f2, r.f3, r.f4] for r in got], hz, atol=0.1)


def test_cepstra_and_contrast_match_numpy(spark):
    mag = np.abs(RNG.normal(size=(12, 1025))) + 1e-3
    mag[5] = 1e-12  # floored at 80 dB below the loudest
    df = spark.createDataFrame([("a", i, [float(v) for v in m], 0) for i, m in enumerate(mag)], "clip_id string, frame_id long, mag array<double>, seg int")
    mel = sig.db(mag**2 @ sig.mel_weights(16000, 2048, 32).T)
    want = sig.cepstrum(np.maximum(mel, mel.max() - 80), 13)
    got = SP.mel_cepstra(df, 16000, 2048, 32, 13).orderBy("frame_id").toPandas()["mfcc"]
    np.testing.assert_allclose(np.stack(got.to_list()), want, atol=1e-6)
    freqs = np.fft.rfftfreq(2048, 1 / 16000)
    p, v = sig.contrast_levels(mag, freqs)
    want = (np.maximum(p, p.max() - 80) - np.maximum(v, v.max() - 80)).mean(1)
    got = SP.band_contrast(df, freqs).orderBy("frame_id").toPandas()["contrast"]
    np.testing.assert_allclose(got.to_numpy(), want, atol=1e-6)


def test_pitch_of_a_tone(spark):
    t = np.arange(1024) / 16000
    got = SP.pitch_of(frames(spark, [np.sin(2 * np.pi * 200 * t), np.zeros(1024), RNG.normal(size=1024)]), 16000, 60, 500).orderBy("frame_id").collect()
    assert got[0].voiced and got[0].f0 == pytest.approx(200, abs=1) and not got[1].voiced and not got[2].voiced
