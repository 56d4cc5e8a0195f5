"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed with ``write.format('noop')`` (full execution, no
output cost) after a warm-up run of a small query.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagweave.session import get_spark  # noqa: E402
from tagweave.plans import registry  # noqa: E402

HEADLINE = ["preprocess", "tfidf", "keyword_tags", "page_keyword_tags", "rule_groups", "kmeans_groups",
            "similar_pairs", "dbscan", "textrank", "pair_counts", "mean_cosine", "entity_tags", "tag_fold",
            "density_clusters", "lemmatized", "current_tags"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in registry.QUERIES]
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="tagweave-bench",
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "24g")})
    # warm-up (untimed): every query once on the smallest tables, so JIT, codegen and Python
    # workers are ready and no timed query pays for them
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()   # no query reuses data persisted by an earlier one
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
