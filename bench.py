"""Time the headline queries; prints one JSON line.

Every query is built and run to its last row into a sink that discards the rows. The session is
warmed up on the smallest tables first, so compilation of Spark itself is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketwise.plans import registry  # noqa: E402
from basketwise.session import build_session  # noqa: E402

HEADLINE = (
    "order_facts",
    "executive_kpis",
    "revenue_growth_30d",
    "revenue_by_month",
    "monthly_growth",
    "revenue_by_category",
    "revenue_by_channel",
    "product_performance",
    "high_margin_low_volume",
    "customer_performance",
    "rfm_segmentation",
    "seasonal_category_spikes",
    "growth_signals",
    "full_analysis",
    "business_context",
    "validation_summary",
    "clean_orders",
    "quarantine",
    "document_chunks",
    "upsert_chunks",
    "vector_top_k",
    "multi_topic_retrieval",
    "report_verdict",
    "map_actions",
    "apply_status_updates",
    "latest_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("monthly_growth", "rfm_segmentation", "vector_top_k"):
            run(name, small)
    seconds = {name: round(run(name, folder), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
