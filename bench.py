"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqlab.plans.catalog import QUERIES  # noqa: E402
from seqlab.session import build_session  # noqa: E402

HEADLINE = [
    "vocab_count",
    "preprocess_corpus",
    "most_frequent_tag",
    "ngram_counts",
    "sentence_loglik",
    "perplexity",
    "context_features",
    "held_out_accuracy",
    "viterbi_decode",
    "score_linear",
    "greedy_decode",
    "train_softmax",
    "model_agreement",
    "seeded_shuffle",
    "weighted_draw",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, spark__sql__shuffle__partitions=cpus)
    # Start the engine and read the inputs once, so that the first query is not charged for it.
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
