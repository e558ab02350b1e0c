"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from histmetrics.demo import QUERIES
from histmetrics.demo.frames import history
from histmetrics.session import build_session

HEADLINE = (
    "hotspots",
    "module_timeseries",
    "module_snapshot",
    "file_distributions",
    "module_distributions",
    "line_counts",
    "assemble_file_metrics",
    "reduce_edge_facts",
    "build_coupling_edges",
    "module_scores",
    "link_methods",
    "relations_diff",
    "structure_timeseries",
    "edge_evidence",
    "neighborhood",
    "parse_commit_log",
    "plan_versions",
    "document_line_counts",
    "python_module_distributions",
    "xml_reference_facts",
    "run_status",
    "upsert_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["line_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    if "hotspots" in names:  # the stored history that the reads below share
        begin = time.perf_counter()
        history(spark, sf_dir)
        seconds["write_history"] = round(time.perf_counter() - begin, 3)
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
