"""Recordings written as WAV files: closed forms, and blocks against whole clips."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import wav_bytes
from voxledger import constants as K
from voxledger.functions import signal as sig
from voxledger.functions.ordered import ordered, with_segments
from voxledger.operators import frames as FR
from voxledger.operators import profiles as R
from voxledger.operators import windows as W
from voxledger.plans import calibrate, pair
from voxledger.plans import prepare as prep_plan
from voxledger.plans import scan as scan_plan
from voxledger.sources import pcm, recordings

T = np.arange(16000 * 3) / 16000


def voice(f0, seed):
    r = np.random.default_rng(seed)
    ph = 2 * np.pi * np.cumsum(f0 * (1 + 0.05 * np.sin(2 * np.pi * 3 * T))) / 16000
    x = sum(np.sin(k * ph) / k for k in range(1, 18)) * (0.3 + 0.25 * np.sin(4 * np.pi * T))
    x[20000:26000] *= 0.001
    return 0.2 * x + 0.001 * r.normal(size=len(T))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("clips")
    (d / "spk1").mkdir()
    (d / "spk2").mkdir()
    (d / "spk1" / "a1.wav").write_bytes(wav_bytes(voice(120, 1)))
    (d / "spk1" / "a2.WAV").write_bytes(wav_bytes(np.repeat(voice(122, 2), 2), channels=2))
    (d / "spk2" / "b1.wav").write_bytes(wav_bytes(voice(210, 3)))
    (d / "tone.wav").write_bytes(wav_bytes(0.3 * np.sin(2 * np.pi * 220 * T)))
    (d / "silent.wav").write_bytes(wav_bytes(T * 0))
    (d / "short.wav").write_bytes(wav_bytes(0.3 * np.sin(2 * np.pi * 440 * T[:8000])))
    (d / "rate.wav").write_bytes(wav_bytes(0.3 * np.sin(T), sr=8000))
    (d / "bad.wav").write_bytes(b"RIFFxxxx")
    (d / "empty.flac").write_bytes(b"")
    (d / "note.txt").write_bytes(b"x")
    return str(d)


@pytest.fixture(scope="module")
def files(spark, folder):
    return recordings.scan_recordings(spark, folder)


@pytest.fixture(scope="module")
def prepared(files):
    return prep_plan.prepare(files)


@pytest.fixture(scope="module")
def features(prepared):
    return scan_plan.rows_of_clip(prepared).cache()


def test_scan_rejects_and_prunes(files):
    reasons = {r["clip_id"]: r["reject_reason"] for r in files.collect()}
    assert reasons["note.txt"] == "unsupported_format" and reasons["spk1/a2.WAV"] is None
    assert "empty.flac" not in reasons  # the file source does not list files without bytes
    plan = recordings.accepted(files).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), GreaterThan(length,0)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_speakers(files):
    d = recordings.with_speaker(files.where("path RLIKE 'spk'"))
    assert {r["speaker"]: r["n_files"] for r in recordings.speaker_index(d).collect()} == {"spk1": 2}
    both = recordings.speaker_index(d, d.where("clip_id LIKE 'spk2%'")).collect()
    assert {r["speaker"]: r["n_files"] for r in both} == {"spk1": 2, "spk2": 2}


def test_equal_names_are_two_clips(spark, tmp_path):
    """The same base name in two folders, below roots given in several ways."""
    for spk, f0 in (("s1", 120), ("s2", 210)):
        (tmp_path / spk).mkdir()
        (tmp_path / spk / "utt1.wav").write_bytes(wav_bytes(voice(f0, f0)))
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", f"file:{tmp_path}"):
        found = recordings.scan_recordings(spark, root)
        assert {r["clip_id"] for r in found.select("clip_id").collect()} == {"s1/utt1.wav", "s2/utt1.wav"}
    one = recordings.scan_recordings(spark, f"{tmp_path}/s*")
    assert {r["clip_id"][-11:] for r in one.select("clip_id").collect()} == {"s1/utt1.wav", "s2/utt1.wav"}
    clips = prep_plan.prepare(found).clips.collect()
    assert len(clips) == 2 and not any("downmix" in s for r in clips for s in r["steps"])


def test_long_clips_are_taken_whole(spark, tmp_path):
    (tmp_path / "long.wav").write_bytes(wav_bytes(np.tile(0.3 * np.sin(2 * np.pi * 220 * T), 44)[: 16000 * 130]))
    found = recordings.scan_recordings(spark, str(tmp_path))
    whole_clip, cut = prep_plan.prepare(found).clips.first(), prep_plan.prepare(found, max_seconds=120).clips.first()
    assert whole_clip["speech_sec"] == 130.0 and not any("Truncated" in s for s in whole_clip["steps"])
    assert cut["speech_sec"] == 120.0 and "Truncated to 120s" in cut["steps"]


@pytest.mark.parametrize("fmt,bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_decode(fmt, bits):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    if fmt == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        body = b"".join(int(v * 2 ** (bits - 1)).to_bytes(bits // 8, "little", signed=True) for v in x)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, fmt, 2, 16000, 0, 0, bits, b"data", len(body))
    rate, y = pcm.decode_wav(head + body)
    assert rate == 16000
    np.testing.assert_allclose(y, x.reshape(2, 2))


def test_mono_blocks_equal_the_channel_mean(spark):
    """Decoded, averaged and cut in one task; broken and empty files are one row each."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.uniform(-0.5, 0.5, (20500, 3)) * 32768).astype("<i2")
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 3, 16000, 0, 0, 16, b"data", x.nbytes)
    files = [("a", head + x.tobytes()), ("bad", b"RIFF"), ("none", None), ("empty", head[:-4] + struct.pack("<I", 0))]
    d = spark.createDataFrame(files, "clip_id string, content binary")
    rows = pcm.mono_blocks(d).where("clip_id = 'a'").orderBy("block_id").collect()
    assert [len(r["xs"]) for r in rows] == [8000, 8000, 4500] and {(r["n_clip"], r["channels"]) for r in rows} == {(20500, 3)}
    np.testing.assert_allclose(np.concatenate([r["xs"] for r in rows]), x.mean(axis=1) / 32768, atol=1e-12)
    by_shuffle = pcm.downmix_blocks(pcm.pcm_blocks(d)).orderBy("block_id").collect()
    assert [r["xs"] for r in by_shuffle] == [r["xs"] for r in rows]
    cut = pcm.mono_blocks(d, max_seconds=0.75).where("error IS NULL").orderBy("block_id").collect()
    assert [len(r["xs"]) for r in cut] == [8000, 4000]
    assert {r["clip_id"]: r["error"] for r in pcm.mono_blocks(d).where("error IS NOT NULL").collect()} == {"bad": "not_riff_wave", "none": "not_riff_wave", "empty": "empty"}


def test_rejects(prepared):
    got = {r["clip_id"]: r["reason"] for r in prepared.rejects.collect()}
    assert got == {
        "note.txt": "unsupported_format", "bad.wav": "not_riff_wave", "rate.wav": "sample_rate_8000",
        "silent.wav": "silent_or_empty", "short.wav": "too_short",
    }


def test_clips(prepared):
    by = {r["clip_id"]: r for r in prepared.clips.collect()}
    assert set(by) == {"spk1/a1.wav", "spk1/a2.WAV", "spk2/b1.wav", "tone.wav"}
    assert by["spk1/a2.WAV"]["steps"][0] == "Stereo -> Mono downmix"
    assert by["tone.wav"]["custody"]["raw_duration_sec"] == 3.0 and by["tone.wav"]["speech_sec"] == 3.0
    assert "tier2" in by["spk1/a1.wav"]["steps"][0] and by["spk1/a1.wav"]["speech_sec"] < 3.0
    rms = prepared.frames.groupBy("clip_id").agg(F.expr("sqrt(sum(aggregate(xs, 0D, (s, x) -> s + x * x)) / sum(n))").alias("r"))
    assert all(r["r"] == pytest.approx(0.1, abs=1e-3) for r in rms.collect())


def whole(prepared, clip):
    rows = prepared.blocks.where(F.col("clip_id") == clip).orderBy("block_id").collect()
    assert all(len(r["xs"]) == pcm.BLOCK for r in rows[:-1])
    return np.concatenate([r["xs"] for r in rows])


def test_block_features_equal_whole_clip(prepared, features):
    for clip in ("spk1/a1.wav", "tone.wav"):
        x = whole(prepared, clip)
        got = features.where(F.col("clip_id") == clip).orderBy("frame_id").toPandas()
        mag = np.abs(sig.spectrum(sig.centred(x, 2048, 256)))
        assert list(got["frame_id"]) == list(range(len(mag)))
        freqs = np.fft.rfftfreq(2048, 1 / 16000)
        mel = sig.db(mag**2 @ sig.mel_weights(16000, 2048, 128).T)
        mel = np.maximum(mel, mel.max() - 80)
        np.testing.assert_allclose(np.stack(got["mfcc"]), sig.cepstrum(mel, 13), atol=1e-6)
        c, b, r85, r95 = sig.shape(mag, freqs, (0.85, 0.95))
        for name, want in (("centroid", c), ("bandwidth", b), ("rolloff", r85), ("rolloff95", r95)):
            np.testing.assert_allclose(got[name], want, atol=1e-6)
        for step, name in ((1, "onset"), (2, "onset2")):
            rise = np.concatenate([np.zeros(step), np.maximum(0, mel[step:] - mel[:-step]).mean(axis=1)])
            np.testing.assert_allclose(got[name], rise, atol=1e-6)
        np.testing.assert_allclose(got["rms"], np.sqrt((sig.centred(x, 512, 256) ** 2).mean(axis=1)), atol=1e-9)
        level = sig.db(mag**2)
        np.testing.assert_allclose(got["mean_db"], np.maximum(level, level.max() - 80).mean(axis=1), atol=1e-6)


def test_pitch_of_a_tone(prepared):
    p = FR.pitch_frames(FR.with_context(prepared.blocks, 2048), pcm.BLOCK)
    f0 = [r["f0"] for r in p.where("clip_id = 'tone.wav' AND frame_id BETWEEN 8 AND 170").collect()]
    assert len(f0) == 163 and np.allclose(f0, 220, atol=0.5)
    x = whole(prepared, "spk1/a1.wav")
    want, _ = sig.yin(sig.centred(x, 2048, 256), 16000, 60, 500)
    got = p.where("clip_id = 'spk1/a1.wav'").orderBy("frame_id").toPandas()
    np.testing.assert_allclose(got["f0_any"], want, atol=1e-6)


def test_tone_profile(prepared, features):
    crest = {r["clip_id"]: r["crest_factor_db"] for r in R.crest_factor(prepared.frames).collect()}
    assert crest["tone.wav"] == pytest.approx(3.01, abs=0.01)
    # the band is as wide as the window's main lobe, centred on the tone
    mid = features.where("clip_id = 'tone.wav' AND frame_id BETWEEN 8 AND 170").agg(F.avg("centroid")).first()[0]
    assert mid == pytest.approx(220, abs=15)


def test_formants_of_a_known_filter(spark):
    """Noise through four resonances is analysed back to them."""
    rng = np.random.default_rng(0)
    want = [600.0, 1400.0, 2400.0, 3600.0]
    poly = np.array([1.0])
    for f in want:
        r = np.exp(-np.pi * 60 / 16000)
        poly = np.convolve(poly, [1, -2 * r * np.cos(2 * np.pi * f / 16000), r * r])
    e, y = rng.normal(size=16000), np.zeros(16000)
    for i in range(16000):
        y[i] = e[i] - sum(poly[k] * y[i - k] for k in range(1, len(poly)) if i >= k)
    rows = [("c", i, [float(v) for v in y[i * 400 : i * 400 + 800]], -1) for i in range(38)]
    fr = spark.createDataFrame(rows, "clip_id string, frame_id long, xs array<double>, seg int")
    p = fr.select("clip_id", "frame_id", (F.col("frame_id") % 2 == 0).alias("voiced"))
    out = FR.formant_frames(fr, p)
    assert out.where("frame_id % 2 = 1").count() == 0
    med = out.agg(*[F.median(f"f{i}") for i in range(1, 5)]).first()
    assert len([1 for m, w in zip(med, want) if abs(m - w) < 120]) >= 2


def test_windows_from_blocks(prepared):
    d = ordered(prepared.blocks, ["clip_id"], ["block_id"], totals={"n_clip": ("sum", F.size("xs"))})
    rows = W.window_blocks(d).where("clip_id = 'spk1/a1.wav'").orderBy("window_id").collect()
    x = whole(prepared, "spk1/a1.wav")
    assert len(rows) == (len(x) - 24000) // 8000 + 1
    for r in rows:
        np.testing.assert_allclose(r["xs"], x[r["window_id"] * 8000 : r["window_id"] * 8000 + 24000])


def test_scan_and_pairs(spark, prepared, features):
    scores = spark.createDataFrame([("spk1/a1.wav", 10.0), ("spk2/b1.wav", 130.0)], "clip_id string, score double")
    s = scan_plan.scan(prepared, scores, features=features)
    clips = {r["clip_id"]: r for r in s.clips.collect()}
    assert clips["spk1/a1.wav"]["model"] == 10.0 and clips["spk2/b1.wav"]["model"] == 100.0 and clips["tone.wav"]["model"] == 50.0
    assert all(2 <= r[c] <= 98 for r in s.windows.collect() for c in ("vocoder_score", "spectral_score", "prosody_score"))
    tone = s.windows.where("clip_id = 'tone.wav' AND window_id = 1").first()
    assert K.CHECKS["entropy_severe"] in tone["triggered_checks"] and K.CHECKS["jitter_low"] in tone["triggered_checks"]

    prof = pair.clip_profiles(prepared, features).cache()
    pairs = spark.createDataFrame(
        [(1, "spk1/a1.wav", "spk1/a1.wav"), (2, "spk1/a1.wav", "spk2/b1.wav"), (3, "spk1/a1.wav", "silent.wav"), (4, "spk1/a2.WAV", "spk1/a1.wav")], "pair_id int, a_id string, b_id string"
    )
    emb = prof.select("clip_id", F.col("mfcc_mean").alias("embedding"))
    res = pair.compare_pairs(pairs, prof, s.clips, emb, emb)
    by = {r["pair_id"]: r for r in res.collect()}
    assert by[1]["pitch"] == by[1]["spectral_mfcc"] == by[1]["rhythm"] == by[1]["energy"] == 100.0
    assert by[2]["pitch"] < by[1]["pitch"] and by[4]["pitch"] > by[2]["pitch"]
    assert by[3]["verdict"] == "Cannot Compare" and by[3]["no_speech_files"] == ["Comparison Sample"]

    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "pair_id int, label int")
    report, weights = calibrate.pair_calibration(res, labels)
    assert {r["signal"]: r["auc"] for r in report.collect()}["pitch"] == 1.0
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    truth = spark.createDataFrame([("spk1/a1.wav", 0, "LIKELY_AUTHENTIC", False), ("spk2/b1.wav", 1, "FULLY_SYNTHETIC", False)], "clip_id string, label int, truth string, spliced boolean")
    report, acc = calibrate.scan_calibration(s.clips, truth)
    assert report.count() == 5 and acc.count() == 1


def test_onsets_match_sequential_rule(spark, features):
    clip = features.where("clip_id = 'spk1/a1.wav'")
    rise = np.array([r["onset"] for r in clip.orderBy("frame_id").collect()])
    env = np.concatenate([np.zeros(5), rise[1:]])[: len(rise)]
    v = (env - env.min()) / (env.max() - env.min())
    picked, last = [], -9
    for i in range(len(v)):
        near, around = v[max(0, i - 1) : i + 1], v[max(0, i - 6) : i + 7]
        if v[i] > 0 and v[i] == near.max() and v[i] >= around.mean() + 0.07 and i > last + 1:
            picked.append(i)
            last = i
    got = [r["frame_id"] for r in FR.onsets(FR.onset_envelope(clip), reach=16).orderBy("frame_id").collect()]
    assert got == picked and len(got) > 3


def test_user_model_scores_batches(spark):
    def make():
        return lambda x: x.sum(axis=1)

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id int, v array<double>")
    out = df.withColumn("s", FR.predict_scores(df, "v", 2, make)).collect()
    assert all(r["s"] == r["id"] + 1 for r in out)


def test_hot_clip_gives_the_same_verdict(spark, files, prepared, features, hot):
    """The whole scan with every clip cut into pieces equals the plain one."""
    cut = prep_plan.prepare(files)
    assert cut.blocks.groupBy("clip_id").agg(F.countDistinct("seg").alias("n")).agg(F.max("n")).first()[0] > 1
    spark.conf.unset("spark.voxledger.pieceRows")
    want = {r["clip_id"]: r["speech_samples"] for r in prepared.clips.collect()}
    assert {r["clip_id"]: r["speech_samples"] for r in cut.clips.collect()} == want
    a = scan_plan.scan(cut).clips.drop("span_ratio", "flag_ratio").orderBy("clip_id").collect()
    b = scan_plan.scan(prepared, features=features).clips.drop("span_ratio", "flag_ratio").orderBy("clip_id").collect()
    assert a == b


def test_segments_are_kept_by_files(spark, prepared):
    assert "seg" in prepared.frames.columns
    assert with_segments(prepared.frames, ["clip_id"], "frame_id").columns == prepared.frames.columns


def test_failed_windows_keep_the_job_going(spark):
    """A window without usable samples has no frames and a reason; the others are as without it."""
    from voxledger.operators import frames as FR

    good = [float(v) for v in 0.1 * np.sin(np.arange(8000) / 9)]
    rows = [("a", 0, 0, good), ("a", 1, 0, []), ("a", 2, 0, [float("nan")] * 100), ("a", 3, 0, None), ("a", 4, 0, good)]
    d = spark.createDataFrame(rows, "clip_id string, window_id long, seg int, xs array<double>")
    got = {r.window_id: r for r in FR.window_frames(d).collect()}
    assert [got[k].error is None for k in range(5)] == [True, False, False, False, True]
    assert not got[1].frames and got[1].phase_var is None and got[0].frames == got[4].frames and len(got[0].frames) > 10
