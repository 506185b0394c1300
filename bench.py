"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) apply.
"""

from __future__ import annotations

import json
import os
import re
import time

from pointproc import catalog
from pointproc.session import local_session

HEADLINE = [
    "W1_inter_spike_interval", "W2_refractory", "W3_burst_detection", "A2_burst_counts", "A13_qc_rollup",
    "Q1_percentile_mid", "P10_bh_fdr", "P7_signed_rank_large", "P4_bootstrap_two_level", "P6_study_bootstrap",
    "P17_rate_report", "J4_spike_band_join", "C1_xcorr_pearson", "C6_sttc_edges", "N3_clustering",
    "N5_hop_distances", "N9_greedy_modularity", "N12_small_worldness", "C9_connectivity_study",
    "G4_threshold_detection", "G3_filter_samples", "K1_kernel_density",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    queries = catalog.queries()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM before the clock
    times = {}
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
