"""Headline queries on the given tables: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.catalog import QUERIES, views  # noqa: E402
from lodestone.plans.index import build_index  # noqa: E402
from lodestone.session import local_session  # noqa: E402

HEADLINE = (
    "semantic_search",
    "keyword_search",
    "cascade_search",
    "prompts",
    "message_intents",
    "answered_messages",
    "retrieval_confusion",
    "usage_totals",
    "latency_per_method",
    "tokens_per_call",
    "events_per_hour",
    "hourly_rollup",
    "continuous_rollup",
    "rewritten_kb",
    "redundant_categories",
    "text_length_summary",
    "quiz_items",
    "graded_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    def index() -> None:
        build_index(views.kb(spark, sf_dir), views.INDEX_COLS, views.dedup_key())

    # one small pass first, so that the numbers are not those of a cold JVM
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            run(QUERIES[name](spark, warm))

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    timed("build_index", index)
    timed("build_word_index", lambda: views.words_of(spark, sf_dir))
    views.index_of(spark, sf_dir)  # both are shared by the searches below, as in a service
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, sf_dir)))

    counts = {n: views.table(spark, sf_dir, n).count() for n in ("documents", "benchmark")}
    pairs = counts["documents"] * counts["benchmark"]
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "query_document_pairs_per_sec": round(pairs / times["semantic_search"]),
                "docs_indexed_per_sec": round(counts["documents"] / times["build_index"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
