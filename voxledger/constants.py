"""Thresholds, weights, tolerances and wording.

All of these are agreed values that results must be computed with; they are
stated here once and passed to operators as default arguments.
"""

# --- audio geometry -------------------------------------------------------
SAMPLE_RATE = 16_000
MAX_SECONDS = 120
MIN_SPEECH_SECONDS = 0.8
MAX_FILE_BYTES = 500 * 1024 * 1024
EXTENSIONS = (".wav", ".mp3", ".flac", ".ogg", ".m4a")
HOP = 256
WINDOW_SECONDS = 1.5
WINDOW_HOP_SECONDS = 0.5
WINDOW_SAMPLES = 24_000
WINDOW_HOP_SAMPLES = 8_000
EMBED_WINDOW_SECONDS = 6
EMBED_STRIDE_SECONDS = 2
EMBED_SINGLE_SECONDS = 8
EMBED_MIN_SECONDS = 0.5
N_MFCC = 13
CURVE_POINTS = 60
ENVELOPE_POINTS = 150

# --- speech gating --------------------------------------------------------
GATE_FRAME = 320
GATE_FLOOR_QUANTILE = 0.02
GATE_MARGIN_DB = 6.0
GATE_UNIFORM_STD_DB = 3.0
GATE_MIN_ACTIVE = 0.20
GATE_SILENCE_DB = -60.0
TRIM_UNIFORM_DB = 40.0
TRIM_FALLBACK_DB = 30.0
TRIM_FRAME = 2048
TRIM_HOP = 512
TRIM_MIN_SECONDS = 0.1
TARGET_RMS = 0.1

# --- scan -----------------------------------------------------------------
HF_BAND_HZ = 6500.0
BOUNDARY_SIGMAS = 2.2
SUSPICION_COMBINED = 38.0
SUSPICION_SPECTRAL = 88.0
INTERVAL_TOLERANCE = 0.55
SIGNAL_GAP = 35.0
COMBINED_WEIGHTS = {"spectral_score": 0.40, "vocoder_score": 0.35, "prosody_score": 0.25}
COMPOSITE_WEIGHTS = {"spectral": 0.35, "vocoder": 0.30, "prosody": 0.25, "model": 0.10}
SIGNAL_NAMES = {
    "model": "Neural Spoof Model [TRAINED]",
    "vocoder": "Vocoder Artifacts [ACOUSTIC HEURISTIC]",
    "spectral": "Spectral Consistency [TEMPORAL HEURISTIC]",
    "prosody": "Prosody Naturalness [STATISTICAL HEURISTIC]",
}
CHECKS = {
    "ripple": "High-Frequency Ripple >6.5kHz",
    "hnr": "HNR Anomaly (Out of Natural Speech Range)",
    "phase": "Phase Coherence Irregularity",
    "room": "Noise Floor / Room Tone Discontinuity",
    "entropy_severe": "Severely Constrained Pitch Entropy (Neural TTS Signature)",
    "entropy_low": "Low Pitch Entropy (Monotonic / Constrained Intonation)",
    "jitter_high": "Elevated F0 Tracking Micro-Jitter (Neural Vocoder Phase Artefact)",
    "jitter_low": "Over-Smooth Pitch Contour (Synthetic Spline Interpolation)",
    "energy": "Flat Energy Envelope (Low Dynamic Variation)",
}
SYNTHETIC, SPLICED, AUTHENTIC = "FULLY_SYNTHETIC", "SPLICED_PARTIAL", "LIKELY_AUTHENTIC"
CATEGORY_LABELS = {
    SYNTHETIC: "Entirely Synthetic / AI-Generated Speech",
    SPLICED: "Partial Splicing / Localized Synthetic Injection",
    AUTHENTIC: "Likely Authentic Human Speech",
}

# --- pair comparison ------------------------------------------------------
DIMENSION_WEIGHTS = {
    "neural_identity": 0.30,
    "formants": 0.25,
    "pitch": 0.25,
    "spectral_mfcc": 0.15,
    "rhythm": 0.03,
    "energy": 0.02,
}
# order in which dimensions are listed and compared with one another
DIMENSION_ORDER = ("neural_identity", "spectral_mfcc", "energy", "pitch", "formants", "rhythm")
DIMENSION_GAP = 25.0
VERDICTS = (
    (85.0, "Very Likely Same Speaker"),
    (75.0, "Likely Same Speaker"),
    (60.0, "Inconclusive"),
    (45.0, "Likely Different Speaker"),
)
VERDICT_BELOW = "Very Likely Different Speaker"
VERDICT_COLOURS = {
    "Very Likely Same Speaker": "green",
    "Likely Same Speaker": "lime",
    "Inconclusive": "yellow",
    "Likely Different Speaker": "orange",
    "Very Likely Different Speaker": "red",
}
DIMENSION_PHRASES = {
    "neural_identity": "Neural speaker embeddings",
    "pitch": "Pitch contour & range",
    "formants": "Vocal tract formants (F1-F4)",
    "spectral_mfcc": "Spectral & MFCC fingerprint",
    "rhythm": "Speaking rate & rhythm",
    "energy": "Energy dynamics",
}
RADAR_LABELS = {
    "neural_identity": "Neural Identity",
    "formants": "Vocal Tract",
    "pitch": "Pitch & Intonation",
    "spectral_mfcc": "Spectral Shape",
    "rhythm": "Speaking Rhythm",
    "energy": "Energy Dynamics",
}
TELEMETRY_LABELS = {
    "neural_identity": "Neural Speaker Identity",
    "pitch": "Pitch & Intonation (F0)",
    "formants": "Vocal Tract Formants (F1–F4)",
    "spectral_mfcc": "Spectral & MFCC Fingerprint",
    "rhythm": "Speaking Rate & Rhythm",
    "energy": "Energy Dynamics",
}
PITCH_TOLERANCES, PITCH_WEIGHTS = (80, 12, 10), (0.50, 0.35, 0.15)
FORMANT_TOLERANCES, FORMANT_WEIGHTS = (200, 300, 350, 400, 300), (0.25, 0.30, 0.20, 0.10, 0.15)
RHYTHM_TOLERANCES, RHYTHM_WEIGHTS = (5, 6, 0.5, 1), (0.35, 0.35, 0.15, 0.15)
SPECTRAL_TOLERANCES, SPECTRAL_WEIGHTS = (2000, 3000, 80), (0.20, 0.15, 0.15)
SPECTRAL_COSINE_WEIGHT = 0.50

# --- evaluation -----------------------------------------------------------
CURVE_THRESHOLDS = 1000
TARGET_FARS = (0.001, 0.01, 0.05)
IMPUTE_PAIR, IMPUTE_SCAN = 50.0, 20.0

# --- sessions and jobs ----------------------------------------------------
SESSION_MINUTES = 30
JOB_EXPIRY_SECONDS = 3600
