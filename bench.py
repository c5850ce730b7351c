"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans import filters, more, queries  # noqa: E402, F401
from marketlens.session import build_session  # noqa: E402

HEADLINE = ["rule_all_scores", "rule_scores", "rule_spread", "agg_outlier_free", "agg_price_summary", "join_waterfall", "join_open_range", "queue_expand", "win_islands", "set_upsert", "str_compact_key", "cov_profile"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{folder}"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):  # the first one warms up
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total seconds of headline queries, warm median of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
