"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, default 1; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from jurispark import get_session  # noqa: E402
from jurispark.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "clean_text", "term_counts", "doc_freq", "idf_weights", "chi2_weights", "tfidf_vectors",
    "ngrams", "lemmatize", "cluster_index", "stratified_folds", "single_claim", "metric_vector",
    "best_config", "pls_standard_t1", "pls_gini_t1", "pls_standard_t2", "pls_gini_t2",
    "pls_predict", "gini_test_rank", "nb_bernoulli", "knn_predict",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seen = []
        for run in range(runs + 1):  # the first run warms up the JVM
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if run:
                seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
