"""Headline queries, timed end to end. Prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

import json
import os
import time

from tallyscan.plans.queries import QUERIES
from tallyscan.session import local_session

HEADLINE = [
    "a4_dedupe_ingest", "b5_pages_to_document", "d11_rule_fields", "d11_rule_fields_corpus", "e3_validate_accounting",
    "f2_fields_from_tables", "f4_amounts_from_lines", "g4_parse_responses", "i4_apply_text", "k3_latest_status",
    "h5_extract_documents", "j6_corpus_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", "20g")
    spark.range(1000000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
