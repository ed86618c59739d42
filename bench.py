"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, default headline).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from itemlens.plans import suite  # noqa: E402

HEADLINE = [
    "group_ranking", "group_target_matrix", "lift", "top_matrix_region_target", "dedupe_last",
    "top_terms", "top_terms_by_group", "named_term_counts", "count_pattern_mentions", "count_title_mentions",
    "count_catalogue_mentions", "match_fuzzy_name", "resolve_names", "build_registry", "scheme_scrutiny",
    "catalogue_rollup", "compare_by_region", "proposal_spotcheck", "cooccurring_targets", "joint_asker_pairs",
    "cross_group_bridges", "cosine_similarity", "graph_edges", "pagerank", "communities", "group_brief", "overview",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("itemlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = suite.queries()
    queries["group_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
