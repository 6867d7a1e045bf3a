"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "feature_frame", "stratified_split", "rare_level_fold", "null_profile", "numeric_profile", "chi2_table", "cramers_v_matrix",
    "numeric_association", "leakage_audit", "threshold_metrics", "auc_by_score", "average_precision", "best_f1_threshold",
    "model_metric_table", "midrank", "delong_all_pairs", "mcnemar", "bootstrap_delta", "lr_scores", "dt_scores", "rf_scores",
    "gbt_scores", "svm_scores", "nb_scores", "oof_threshold", "permutation_importance", "local_surrogate",
]


def main() -> None:
    from rankfold.plans import REGISTRY
    from rankfold.session import drop_scratch, get_session
    from rankfold.sources.files import evaluate_fully

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("rankfold-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # first job pays for the session's start
    seconds = {}
    for name in names:
        start = time.perf_counter()
        evaluate_fully(REGISTRY[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    drop_scratch(spark)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
