"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from asofgraph.plans import registry
from asofgraph.session import build_session

HEADLINE = ("signal_diffusion", "active_edges_yearly", "listed_intervals", "tradable_panel", "residual_returns", "forward_ic", "round_trips", "daily_pnl", "resolution_ladder", "weak_components", "stratified_sample")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)))
    found, queries = {}, registry.queries()
    queries["calendar"](spark, folder).count()  # starts the session before the clock
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
