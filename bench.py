"""Benchmark: headline queries, each run to completion over its whole result.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS select data and cores.
With query names as arguments, only those run. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bellwether.plans.catalogue import CATALOGUE, run  # noqa: E402
from bellwether.session import get_session  # noqa: E402

HEADLINE = [
    "daily_topk_hit", "price_window_aggregates", "range_features", "hit_priors", "volatility_target", "market_context_lags",
    "point_in_time_small_cap", "exact_quantiles", "conditional_rates", "asof_forward", "bar_offsets", "prior_week_counts",
    "assign_session", "session_window_means", "calendar_windows", "overnight_features", "news_novelty", "bucket_stats",
    "news_features", "link_simple", "link_precise", "event_triples", "event_id_windows", "vocabulary", "skipgram_pairs",
    "vector_mean", "token_pooled_vector_mean", "nearest_words", "first_touch_intraday", "entry_rules", "multi_day_exit",
    "parameter_grid", "threshold_sweep", "performance", "randomization_test", "cluster_bootstrap_mcc", "best_threshold",
    "blend_weight", "forward_return", "flow_event", "boosted_trees", "walk_forward",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM's code paths
    took: dict[str, float] = {}
    for name in names:
        assert name in CATALOGUE, name
        t = time.time()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
