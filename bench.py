"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from vellum import catalog
from vellum.plans import rendered
from vellum.plans.runtime import session

HEADLINE = (
    "mentions_by_term",
    "requirement_rows",
    "candidate_rank",
    "declarative_rows",
    "completeness_verdicts",
    "reference_resolution",
    "citation_sites",
    "verify_citations",
    "offset_round_trip",
    "line_offsets",
    "phrase_search",
    "bm25_top",
    "bounded_match",
    "eval_quantiles",
    "latest_per_key",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    times = {}
    # The corpus is rendered, parsed and stored once a session: a line of its own, not the first query's.
    began = time.time()
    for df in rendered.corpus(spark, sf_dir).values():
        df.count()
    times["parse_corpus"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
