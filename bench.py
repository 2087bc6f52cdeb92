"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from encaje.plans.queries import QUERIES  # noqa: E402
from encaje.session import build_session  # noqa: E402

HEADLINE = [
    "clean_documents", "cv_records", "job_records", "training_samples", "split_80_10_10",
    "vocabulary", "tfidf", "fit_vectorizers", "train_forest", "score_forest", "score_pairs",
    "rank_matches", "topk_jobs_for_cv", "topk_cvs_for_job", "recommend_jobs", "recommend_all",
    "stream_recommend", "eval_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", **{
        "spark__master": f"local[{cpus}]", "spark__ui__enabled": "false",
        "spark__driver__memory": "16g", "spark__sql__shuffle__partitions": "16"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "unit": "sec",
        "value": round(sum(seconds.values()), 2), "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
