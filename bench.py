"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from skeinflow.plans import catalog
from skeinflow.session import local_session

#: What a user of the library runs most: bars to panel, evaluation, retrieval, masking, upserts.
HEADLINE = [
    "daily_bars", "price_features", "fundamentals_ttm", "asof_fundamentals", "asof_events", "sentiment_grid", "feature_panel", "backtest_pnl", "fold_auc", "cosine_top_k",
    "chunk_documents", "mask_documents", "upsert_last_wins", "expectations_report", "stratified_sample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # the session's own start isn't a query's time
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
