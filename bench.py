"""Benchmark: headline jobs at one scale factor; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every job runs from scratch (stage tables are not reused between jobs) and is forced to
completion with the ``noop`` sink, so no result is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sitelore.operators import frontier, hierarchy, state, structure  # noqa: E402
from sitelore.plans import catalog  # noqa: E402
from sitelore.session import local_session  # noqa: E402
from sitelore.sources import html  # noqa: E402
from sitelore.sources.fixtures import tables  # noqa: E402


def run(df: DataFrame) -> int:
    """Force ``df`` with the ``noop`` sink; the rows are counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="sitelore-bench")
    catalog.REUSE_STAGES = False

    def t():
        return tables(spark, sf_dir)

    jobs = {
        # 600k-link frontier (one row per lineitem): clean, dedupe, filter, classify
        "discover_frontier": lambda: frontier.discover_pages(t()["links_bench"], t()["courses_bench"]),
        "discovery_stats_frontier": lambda: frontier.discovery_stats(t()["links_bench"], t()["courses_bench"]),
        # hierarchy over the discovered frontier: explicit modules, prefix equi-join
        "hierarchy_frontier": lambda: hierarchy.build_hierarchy(
            catalog.cut_lineage(frontier.discover_pages(t()["links_bench"], t()["courses_bench"])),
            catalog.cut_lineage),
        # HTML → links and Markdown for every stored page
        "extract_links": lambda: html.extract_links(t()["pages"]),
        "extract_content": lambda: html.extract_content(t()["pages"]),
        # model output → validated records
        "parse_structured": lambda: catalog.QUERIES["parse_structured"](spark, sf_dir),
        # event folds
        "job_summary": lambda: state.job_summary(t()["job_events"]),
        "running_progress": lambda: state.running_progress(t()["job_events"]),
        # the full export: all seven document kinds, rendered to blocks
        "render_documents": lambda: catalog.QUERIES["render_documents"](spark, sf_dir),
        # extractive structuring of scraped text
        "structure_content": lambda: structure.structure_content(catalog.enriched(spark, sf_dir)),
    }
    # warm-up: JVM start and first parquet reads are not part of any job
    run(t()["links"])
    times, rows = {}, {}
    for name, build in jobs.items():
        catalog.reset_stages()
        t0 = time.time()
        rows[name] = run(build())
        times[name] = round(time.time() - t0, 3)
    events = t()["job_events"].count()
    if rows["running_progress"] != events:
        raise SystemExit(f"running_progress: {rows['running_progress']} rows of {events} events")
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_job_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": float(sf.group(1)) if sf else sf_dir, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
