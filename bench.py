"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs to completion through the ``noop`` sink (full execution, nothing
collected to the driver). One untimed pass over the headline set warms the JVM
(code generation, JIT) and the Python workers; then ``BENCH_PASSES`` (default 3)
timed passes follow and each query reports its median. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatprep.session import get_spark  # noqa: E402
from chatprep.plans import QUERIES, load_all  # noqa: E402

PASSES = int(os.environ.get("BENCH_PASSES", "3"))

HEADLINE = [
    "assemble_examples",          # flagship: chat training documents (L=25)
    "assemble_examples_v2",       # L=15, second system text
    "sequence_stats",
    "segment_prompt",             # delimited segments, renumbered ids, reply remap
    "eval_pairs",
    "split_random",               # exact seeded split (histogram cut)
    "context_at_each_message_events",
    "chat_prompt",
    "route_messages",
    "response_plan",
    "response_prompts",
    "segments_per_split",
    "parse_record_replies",
    "normalize_export",           # variant export reader (write + read)
    "history_csv_scan",
    "stream_context",             # keyed streaming state
    "stream_prompts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    load_all()
    for name in HEADLINE:  # warm-up pass, not timed
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    runs = {name: [] for name in HEADLINE}
    for _ in range(PASSES):
        for name in HEADLINE:
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t)
    times = {name: round(statistics.median(v), 3) for name, v in runs.items()}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
