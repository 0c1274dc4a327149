"""Time the headline queries and print one JSON line.

The derived tables are written first and timed as ``prepare``; the queries then read them, as
they would read a published generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pelagia.cluster import local_session  # noqa: E402
from pelagia.plans.queries import QUERIES  # noqa: E402
from pelagia.sources.binding import Binding  # noqa: E402

HEADLINE = [
    "benchmark_taxon_sums", "wide_to_long", "find_samples", "sample_info", "find_taxa_asvs",
    "find_taxa_samples", "taxon_abundance", "taxon_abundance_summary", "diversity",
    "diversity_taxon", "diversity_groups", "association_points", "environment_association",
    "marker_data_join", "reconcile_totals", "marker_report", "context_report", "numeric_profile",
    "coverage", "content_fingerprint", "message_sequence", "session_messages", "trace_list",
    "trace_tree", "trace_overview", "span_violations", "span_merge", "close_open_spans",
    "cascade_delete", "redact_text", "sanitize_payload", "trace_finalise", "span_fold",
    "span_stream", "span_sequence", "span_details", "answer_stream", "taxon_lookup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("pelagia-bench", cores, int(cores))
    seconds: dict[str, float] = {}

    started = time.perf_counter()
    Binding(spark, folder).prepare()
    seconds["prepare"] = round(time.perf_counter() - started, 3)

    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
