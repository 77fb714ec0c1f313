"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "impact_region", "impact_part", "callers_d2", "callees_container", "lookup_node", "graph_stats", "fk_filter_edges",
    "segment_vocab", "search_bm25_or", "search_bm25_phrase", "search_segments", "resolve_chain_priority", "synth_type_of",
    "wire_uses", "changed_files", "resurrect_edges", "extract_java_refs",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from registry import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("codeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    run("graph_stats")  # starts the JVM's code paths
    names = sys.argv[1:] or HEADLINE
    times = {name: run(name) for name in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
