"""Headline timings: prints one JSON line. Reads $BENCH_SF_DIR, runs on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

from pyspark.sql import SparkSession

from veilspark.plans.catalog import queries

HEADLINE = (
    "detect_all",
    "redact_documents",
    "redact_notes",
    "redact_pages",
    "rehydrate_documents",
    "policy_layers",
    "custom_rules",
    "term_dictionary_join",
    "redact_conversations",
    "redact_table_scope",
    "rehydrate_table_scope",
    "reply_rehydration",
    "audit_conversations",
    "entities_total",
    "admission",
    "admission_stream",
    "chunk_rehydration",
    "chunk_stream",
    "vault_round_trip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Otherwise every column expression makes three more calls into the JVM to note its line of code.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every column of every row and keeps nothing.
        chosen[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
