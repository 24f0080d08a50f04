"""Time the headline queries at one scale factor and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_REPEAT (runs, best kept).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace import registry  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = (
    "p1_q1_currency",
    "p2_q2_selection",
    "j1_q3_local_items",
    "t1_q5_tumbling_count",
    "j2_q8_new_sellers",
    "t5_q11_session_count",
    "g2_word_count",
    "j3_ad_click_join",
    "j4_buy_sell_latest_join",
    "m10_wiki_stats",
    "w1_running_price_sum",
    "w3_running_median",
    "w6_ewma",
    "o3_price_levels",
    "m1_match_orders_book",
    "m2_match_orders_single",
    "m3_call_auction",
    "m5_markov_score",
    "m7_train_markov",
    "m8_sentiment_score",
    "m8_sentiment_loaded_lexicon",
    "m9_fraud_nearest_cluster",
    "m11_slo_report",
    "m12_scaling_report",
)

# Table whose rows drive each query, for the rate in rows per second.
DRIVING_TABLE = {
    "p1": "lineitem", "p2": "lineitem", "g2": "documents", "w1": "lineitem", "o3": "lineitem",
    "m1": "lineitem", "m2": "lineitem", "m3": "lineitem", "m9": "lineitem", "j4": "lineitem", "m8": "documents",
    "w3": "lineitem",
}


def driving_table(name: str) -> str:
    return DRIVING_TABLE.get(name.split("_")[0], "events")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cores)
    known = registry.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in known]
    rows = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {driving_table(n) for n in names}
    }
    seconds, rates = {}, {}
    for name in names:
        best = None
        for _ in range(repeat):
            begin = time.perf_counter()
            # Every row is produced and dropped: nothing is collected, nothing is skipped.
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        rates[name] = round(rows[driving_table(name)] / best)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
