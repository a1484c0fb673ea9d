"""Times the headline queries and prints one JSON line.

Each query runs once unrecorded, for compilation and caches of the file system, and then three times into the ``noop``
sink, so every column is computed and nothing is collected. The median counts. A fixed plain Spark job is timed the same way,
to compare the machine between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pyrewatch.plans import load_queries  # noqa: E402
from pyrewatch.session import local_session  # noqa: E402

HEADLINE = (
    "event_types", "accepted_logs", "accepted_metrics", "foreign_rows", "observation_scores", "sequential_detector",
    "anomaly_windows", "selected_logs", "evidence_items", "incident_signals", "template_coverage", "template_similarity",
    "note_chunks", "document_vectors", "similar_documents", "grounding_violations", "canonical_references",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registry = load_queries()

    def fixed(*_):
        return spark.range(30_000_000).groupBy((F.col("id") * 7 % 100_003).alias("k")).agg(F.sum("id").alias("s"))

    def seconds(run) -> float:
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def median(run) -> float:
        seconds(run)
        return round(statistics.median(seconds(run) for _ in range(RUNS)), 3)

    plain = median(fixed)
    times = {name: median(registry[name].run) for name in sys.argv[1:] or HEADLINE}
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale), "fixed_job_sec": plain}), flush=True)


if __name__ == "__main__":
    main()
