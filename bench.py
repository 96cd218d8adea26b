"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from ionforge.plans import registry
from ionforge.session import local_session

# Names are registered queries; a shared stored table is built by the first query that needs it.
HEADLINE = (
    "parse_composition", "reaction_consistency", "validation_rules", "eligibility_split", "flag_identity_conflict",
    "repeated_reaction_review", "connected_groups", "connected_groups_bipartite", "hash_holdout", "balanced_group_folds",
    "assign_partitions", "cv_leakage_audit", "assemble_features", "fit_all_folds", "fit_pca", "median_baseline",
    "regression_metrics", "subgroup_metrics", "score_batch", "profile_contiguity",
    "rbf_ridge", "rbf_eps_regression", "tree_regression", "model_search",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
