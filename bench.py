"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docspan.plans.catalog import queries  # noqa: E402
from docspan.session import local_session  # noqa: E402

HEADLINE = (
    "note_sections", "note_classification", "version_numbers", "version_timeline", "document_contributors", "commit_chain",
    "diff_statistics", "diff_edit_lines", "line_multiset_delta", "drift_by_document", "content_drift", "access_audit", "project_summaries",
    "cascade_impact", "repository_tree", "function_catalogue", "file_roles", "module_signatures", "env_totals", "markdown_tokens",
    "composed_documents", "streamed_versions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "docspan-bench")
    registered = queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the executors
    times = {}
    for name in HEADLINE:
        started = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
