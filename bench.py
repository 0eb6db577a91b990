"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from lodestrata.plans.catalog import QUERIES
from lodestrata.session import session

HEADLINE = [
    "background_removal_local", "background_passthrough", "comp_center_by_site", "group_balance", "variation_matrix", "principal_balances", "triple_collapse",
    "pixel_aggregate", "point_to_pixel", "median_window_clip", "median_filter_nearest", "box_filter", "spectral_indices_guarded", "clr_spearman",
    "subset_search_scores", "regression_metrics", "agreement_metrics", "auc_rank", "quantile_bin_lift", "site_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for k in range(3):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
