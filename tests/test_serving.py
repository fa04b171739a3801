"""Pages, lookups and first rows."""

import pytest
from pyspark.sql import functions as F

from orderloom.operators import serving


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"k{i:03d}", "delivered" if i % 3 else "shipped", i % 7, i) for i in range(137)]
    return spark.createDataFrame(rows, "_id string, order_status string, customer_id int, n int").repartition(5).cache()


def ids(frame):
    return [r["_id"] for r in frame.collect()]


def test_pages_joined_are_the_sorted_table(table):
    expected = sorted(ids(table))
    first = serving.page(table, size=50)
    assert (first.total, first.page, first.size, first.total_pages) == (137, 1, 50, 3)
    pages = [ids(serving.page(table, page=p, size=50).items) for p in range(1, first.total_pages + 1)]
    assert sum(pages, []) == expected
    assert ids(serving.page(table, page=9, size=50).items) == []


def test_keyset_pages_equal_offset_pages(table):
    last, walked = "", []
    while True:
        page = ids(serving.page_after(table, last=last, limit=50))
        if not page:
            break
        walked.append(page)
        last = page[-1]
    assert walked == [ids(serving.page(table, page=p, size=50).items) for p in (1, 2, 3)]


def test_last_key_replaces_a_filter_on_the_key_and_leaves_the_callers_dict(table):
    filters = {"_id": "k001", "order_status": "delivered"}
    assert ids(serving.page_after(table, last="k100", limit=2, filters=filters)) == ["k101", "k103"]
    assert filters == {"_id": "k001", "order_status": "delivered"}


@pytest.mark.parametrize("skip", [0, 1, 63, 120, 136, 137, 500])
def test_deep_pages_seek_their_start(table, skip):
    found = serving.offset_rows(table, "_id", skip, 5, shallow=4, ranges=3)
    assert ids(found) == sorted(ids(table))[skip : skip + 5]


def test_deep_page_with_equal_and_missing_keys(spark):
    rows = [(None,)] * 20 + [("a",)] * 30 + [("b",)] * 5
    table = spark.createDataFrame(rows, "_id string").repartition(3)
    expected = sorted(ids(table), key=lambda k: (k is not None, k))
    for skip in (10, 25, 48, 52):
        assert ids(serving.offset_rows(table, "_id", skip, 5, shallow=2, ranges=4)) == expected[skip : skip + 5]


def test_empty_table_has_one_page(table):
    page = serving.page(table.where("false"))
    assert (page.total, page.total_pages, ids(page.items)) == (0, 1, [])


def test_order_page_by_status(table):
    page = serving.orders_page(table, 1, 100, "shipped")
    assert page.total == 46 and {r["order_status"] for r in page.items.collect()} == {"shipped"}
    assert serving.orders_page(table, 1, 100).total == 137


@pytest.mark.parametrize("arguments", [dict(size=0), dict(size=101), dict(page=0), dict(size=True), dict(size="5")])
def test_bad_page_arguments(table, arguments):
    with pytest.raises(ValueError):
        serving.page(table, **arguments)


def test_bad_status_and_limits(table):
    with pytest.raises(ValueError, match="unknown order status"):
        serving.orders_page(table, status="lost")
    with pytest.raises(ValueError):
        serving.first_of_mart(table, "monthly_metrics", 500)
    with pytest.raises(ValueError):
        serving.orders_of_customer(table, 1, 0)
    with pytest.raises(ValueError):
        serving.page_after(table, limit=0)


def test_lookup(table):
    assert ids(serving.by_key(table, "k005")) == ["k005"]
    assert ids(serving.by_key(table, "missing")) == []


def test_newest_orders_of_a_customer(spark):
    rows = [("a", 1, "2024-01-01"), ("b", 1, "2024-03-01"), ("c", 1, None), ("d", 1, "2024-03-01"), ("e", 2, "2025-01-01")]
    orders = spark.createDataFrame(rows, "_id string, customer_id int, order_purchase_timestamp string")
    assert ids(serving.orders_of_customer(orders, 1)) == ["b", "d", "a", "c"]
    assert ids(serving.orders_of_customer(orders, 1, 2)) == ["b", "d"]
    assert ids(serving.orders_of_customer(orders, 3)) == []


def test_limit_comes_before_the_fallback_key(spark):
    rows = [(None, 1), ("a", 1), ("z", 1)]
    mart = spark.createDataFrame(rows, "category string, orders bigint")
    assert ids(serving.first_of_mart(mart, "category_analytics", 2)) == ["a", "uncategorized"]


def test_reads_are_top_k_plans(table):
    plan = serving.page_after(table.select("_id"), last="k001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_equality_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("_id"), (F.col("id") % 5).alias("customer_id")).write.parquet(path)
    plan = serving.by_key(spark.read.parquet(path), 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_id,7)" in plan
