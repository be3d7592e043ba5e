"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs once to warm
the JVM and once for the clock; results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from broadsheet.registry.queries import QUERIES  # noqa: E402
from broadsheet.session import build_session  # noqa: E402

HEADLINES = (
    "issue_toc",
    "feed_valid_refs",
    "feed_window_filter",
    "feed_take_while",
    "feed_first_wins",
    "fetch_plan_cache_split",
    "page_tokens",
    "page_extract",
    "page_clean_body",
    "page_clean_web",
    "link_index",
    "link_rewrite",
    "group_by_category",
    "author_index",
    "asset_manifest",
    "asset_rewrite",
    "chapter_documents",
    "listing_refs",
    "issue_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = sys.argv[1:] or HEADLINES
    for name in names:
        run(name)
    seconds = {name: run(name) for name in names}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
