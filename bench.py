"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of threads. Each query runs once after
one warm-up of the session; its result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tokenize_documents", "term_frequency", "idf_table", "bm25_topk", "dense_topk", "hybrid_topk", "rrf_fusion", "chunk_hard_split", "chunk_lines",
    "chunk_markdown", "content_hash", "change_detection", "embedding_plan", "ground_truth_spans", "recall_at_k", "build_context", "cache_aside", "index_roundtrip",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quarry import queries
    from quarry.plans.service import SearchService

    def run(name: str) -> float:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run("doc_lengths")  # starts the session's threads and compiles what all share
    run("chunk_lines")
    times = {name: run(name) for name in HEADLINE}
    docs, asked = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "benchmark"))
    chunks = queries.QUERIES["chunk_markdown"](spark, sf_dir).count()
    # questions against an index that is stored and loaded, as a service has it
    store = queries._stored(spark, sf_dir)
    service = SearchService(spark, store.folder)
    questions = queries.questions(spark, sf_dir)
    seconds = []
    for _ in range(2):  # the first run loads the index
        began = time.perf_counter()
        service.search(questions).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    rates = {"stored_questions_per_s": asked / seconds[-1], "files_per_s": docs / times["chunk_markdown"], "chunks_tokenised_per_s": chunks / times["term_frequency"], "questions_per_s": asked / times["bm25_topk"]}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": {k: round(v, 1) for k, v in rates.items()}}))


if __name__ == "__main__":
    main()
