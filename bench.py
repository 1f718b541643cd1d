"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sidlens.plans.queries import QUERIES  # noqa: E402
from sidlens.plans.session import session  # noqa: E402

HEADLINE = ["item_level_eval", "product_level_eval", "hr_ndcg_at_k", "paired_hits", "popularity_buckets", "co_prefix_rate", "nmi", "pair_counts", "ppmi", "adjacency_topk", "rrf_fusion", "rerank_similarity", "pointwise_score", "grid_select"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, 16, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sid_space"](spark, sf_dir).collect()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
