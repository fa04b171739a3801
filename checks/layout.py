"""What bounded reads of orders touch, with and without the layout of a build.

Usage: python -m checks.layout [folder]
"""

from __future__ import annotations

import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame  # noqa: E402

from orderloom import bind, builder, order_documents, run  # noqa: E402
from orderloom.operators import serving  # noqa: E402
from orderloom.operators.access import OrderAccess, first_of_built_mart  # noqa: E402
from orderloom.operators.loads import keyed  # noqa: E402
from orderloom.operators.ranged import RangedTable, write_ranged  # noqa: E402
from orderloom.plans.build import BY_KEY, BY_STATUS, ORDERS, write_documents, write_order_indexes  # noqa: E402

FILES = 8
CUSTOMER, KEY, DEEP, STATUS = 85, 5_000, 6_000, "shipped"


def scanned_rows(result: DataFrame) -> int:
    """Rows the scans of an executed plan handed on, after skipped row groups and pages."""

    def of(plan) -> int:
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        leaves = plan.collectLeaves()
        stages = [leaves.apply(i) for i in range(leaves.size())]
        return sum(of(s.plan()) if hasattr(s, "plan") and "Stage" in s.nodeName() else _rows_of(s) for s in stages)

    return of(result._jdf.queryExecution().executedPlan())


def _rows_of(leaf) -> int:
    return leaf.metrics().apply("numOutputRows").value() if leaf.metrics().contains("numOutputRows") else 0


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        builder("layout")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", str(FILES))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shop = bind(spark, folder)
    target = tempfile.mkdtemp(prefix="layout-")
    write_documents(shop, target, FILES)
    write_order_indexes(spark, target)
    order_documents(shop).documents.repartition(FILES).write.parquet(f"{target}/plain")
    plain = spark.read.parquet(f"{target}/plain")
    access = OrderAccess(*[RangedTable(spark, f"{target}/{name}") for name in (ORDERS, BY_KEY, BY_STATUS)])
    name = "customer_analytics"
    mart = keyed(run(name, shop), "customer_id")
    write_ranged(mart, f"{target}/{name}")
    mart.repartition(FILES).write.parquet(f"{target}/plain-{name}")
    loose, ranged = spark.read.parquet(f"{target}/plain-{name}"), RangedTable(spark, f"{target}/{name}")
    reads: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]] = {
        "newest orders of a customer": (lambda: serving.orders_of_customer(plain, CUSTOMER), lambda: access.of_customer(CUSTOMER)),
        "order by key": (lambda: serving.by_key(plain, KEY), lambda: access.by_id(KEY)),
        "20 orders after a key": (lambda: serving.page_after(plain, last=KEY), lambda: access.after(KEY)),
        f"page {DEEP}": (lambda: serving.orders_page(plain, DEEP).items, lambda: access.page(DEEP).items),
        f"page 3 of {STATUS}": (lambda: serving.orders_page(plain, 3, status=STATUS).items, lambda: access.page(3, status=STATUS).items),
        "first rows of a mart": (lambda: serving.first_of_mart(loose, name), lambda: first_of_built_mart(ranged, name)),
    }
    print(f"{plain.count()} orders, {loose.count()} rows of the mart")
    for what, ways in reads.items():
        for how, read in zip(("plain", "built"), ways):
            times = []
            for _ in range(6):
                start = time.perf_counter()
                result = read()
                rows = result.collect()
                times.append(time.perf_counter() - start)
            found = f"{len(rows)} found, {scanned_rows(result)} rows read"
            print(f"{what}, {how}: {found}, {statistics.median(times[1:]) * 1000:.0f} ms", flush=True)


if __name__ == "__main__":
    main()
