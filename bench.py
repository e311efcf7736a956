"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from voxledger.catalog import load
from voxledger.session import local_session

HEADLINE = [
    "scan_suspect_regions", "syn3_signal_scores", "syn7_merge_intervals", "syn13_interpretation",
    "pre5_energy_profile", "pre12_reject_routing", "win1_sliding_windows", "win3_frames_in_blocks",
    "frm1_spectra", "frm6_onsets", "ind4_vocoder_score", "ind8_9_10_spectral_score", "ind14_16_17_prosody_score",
    "pro1_pitch_profile", "pro4_5_rhythm_profile", "pro10_energy_dynamics", "pro13_embedding_pool",
    "cmp1_3_20_pitch_score", "cmp2_cosine_pct", "cmp10_11_fusion", "cmp14_15_contradictions",
    "eva2_error_curve", "eva5_signal_report", "src3_content_dedup", "src6_trial_pairs", "src7_splice",
    "rep1_2_case_documents", "str1_sessions", "str4_live_scan",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load().QUERIES
    names = list(queries) if "--all" in sys.argv else HEADLINE

    def run(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    run("syn3_signal_scores")  # starts the JVM's compilers and the file cache
    run("frm1_spectra")  # and the Python workers
    times = {n: run(n) for n in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
