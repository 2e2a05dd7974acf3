"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Each query runs twice, the first time also loading classes and generating code; the better time
counts. Results go to the no-op sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from notalake.plans import catalog
from notalake.plans.registry import QUERIES
from notalake.session import local_session

HEADLINE = [
    "totals_reconciliation", "document_verdicts", "item_rules", "cnpj_check", "portfolio_summary", "facet_filter_page", "multi_field_search",
    "number_readers", "cfop_operation_mix", "labelled_fields", "text_items", "xml_headers", "chunks_with_documents", "issuer_semi_join",
    "upsert_latest", "history_timeline", "context_window", "knn_topk", "doc_context_hybrid", "neighbour_consistency", "fixed_chunks",
    "split_chunks", "clean_text", "column_medians", "describe_table", "daily_order_value", "history_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8, memory=os.environ.get("BENCH_MEMORY", "16g"))
    catalog.load()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
