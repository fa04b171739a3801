"""The batch build, its guard, and the layout of the order table."""

import os

import pytest
from pyspark.sql import functions as F

import orderloom as ol
from orderloom.operators import staging
from orderloom.operators.contracts import MARTS
from orderloom.operators.serving import first_of_mart, orders_of_customer
from orderloom.plans import build
from orderloom.plans.aggregates import orders_by_status, payments_by_type, unwound_payments_by_type


@pytest.fixture(scope="module")
def shop(spark, small_folder):
    return ol.bind(spark, small_folder)


@pytest.fixture(scope="module")
def built(spark, shop, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("built"))
    return folder, ol.build_all(shop, folder)


def test_all_tables_are_written_with_their_counts(spark, shop, built):
    folder, counts = built
    assert list(counts) == list(build.TABLES)
    for name, rows in counts.items():
        table = build.read_table(spark, folder, name)
        assert table.count() == rows > 0
        assert "_id" in table.columns
    assert counts["orders"] == shop.orders.count()


def test_built_tables_answer_like_the_sources(spark, shop, built):
    folder, _ = built
    documents = build.read_documents(spark, folder)
    assert unwound_payments_by_type(documents.unwind("payments")).collect() == payments_by_type(
        shop.order_payments, shop.orders
    ).collect()
    by_status = orders_by_status(documents.documents).collect()
    assert by_status == orders_by_status(shop.orders).collect()


@pytest.mark.parametrize("name", MARTS)
def test_first_rows_of_built_marts(spark, shop, built, name):
    folder, _ = built
    mart = build.read_table(spark, folder, name)
    assert first_of_mart(mart, name, 10).collect() == first_of_mart(ol.run(name, shop), name, 10).collect()


def test_a_complete_build_is_not_repeated(spark, shop, built):
    folder, _ = built
    assert build.is_built(spark, folder)
    assert ol.build_once(shop, folder) is None


def test_a_half_finished_build_is_repeated(spark, shop, tmp_path):
    folder = str(tmp_path / "half")
    build.write_ranged(shop.orders, f"{folder}/build-left/orders", "order_id")
    assert not build.is_built(spark, folder)
    assert ol.build_once(shop, folder)["orders"] == shop.orders.count()
    assert build.is_built(spark, folder)


def test_a_failing_rebuild_leaves_the_build_before(spark, shop, tmp_path):
    folder = str(tmp_path)
    before = ol.build_all(shop, folder)
    version = build.published(spark, folder)
    twice = shop.customers.unionByName(shop.customers)
    changed = ol.Shop(**(shop.tables() | {"sellers": shop.sellers.limit(3), "customers": twice}))
    with pytest.raises(build.DuplicateKeyError):
        ol.build_all(changed, folder)
    assert build.published(spark, folder) == version
    assert build.read_table(spark, folder, "sellers").count() == before["sellers"]
    assert sorted(os.listdir(folder)) == sorted([version, build.MANIFEST] + [f for f in os.listdir(folder) if f.startswith(".")])
    left = [f for _, folders, _ in os.walk(staging.shared_folder(spark)) for f in folders]
    assert not [f for f in left if f.startswith("order-totals-")]


def test_a_rebuild_replaces_all_tables_at_once(spark, shop, tmp_path):
    folder = str(tmp_path)
    ol.build_all(shop, folder)
    first = build.published(spark, folder)
    fewer = ol.Shop(**(shop.tables() | {"sellers": shop.sellers.limit(3)}))
    for _ in range(2):
        assert ol.build_all(fewer, folder)["sellers"] == 3
    assert build.read_table(spark, folder, "sellers").count() == 3
    kept = [f for f in os.listdir(folder) if f.startswith(build.VERSION)]
    assert len(kept) == 2 and build.published(spark, folder) in kept and first not in kept


def test_writing_replaces_a_table_even_by_nothing(spark, shop, tmp_path):
    path = str(tmp_path / "t")
    assert build.write_ranged(shop.sellers, path, "seller_id") == shop.sellers.count()
    assert build.write_ranged(shop.sellers.where("false"), path, "seller_id") == 0
    table = build.RangedTable(spark, path)
    assert table.rows().columns == shop.sellers.columns
    assert (table.rows().count(), table.total(), table.at_rank(0, 5).count()) == (0, 0, 0)


def test_repeated_order_ids_are_an_error(shop, tmp_path):
    twice = ol.Shop(**(shop.tables() | {"orders": shop.orders.union(shop.orders)}))
    with pytest.raises(build.DuplicateKeyError):
        ol.build_all(twice, str(tmp_path))


def test_unknown_table(spark, built):
    with pytest.raises(KeyError):
        build.read_table(spark, built[0], "geolocation")


def test_customers_lie_together_and_large_ones_are_split(spark, shop, tmp_path):
    hot = shop.orders.withColumn("customer_id", F.when(F.col("order_id") % 3 > 0, 7).otherwise(F.col("customer_id")))
    folder = str(tmp_path)
    assert build.write_documents(ol.Shop(**(shop.tables() | {"orders": hot})), folder, 8) == hot.count()
    written = spark.read.parquet(f"{folder}/orders/rows").withColumn("file", F.col("_metadata.file_name"))
    by_file = written.groupBy("file").agg(F.min("customer_id").alias("low"), F.max("customer_id").alias("high"))
    ranges = sorted((r["low"], r["high"]) for r in by_file.collect())
    assert len(ranges) == 8
    assert all(before[1] <= after[0] for before, after in zip(ranges, ranges[1:]))
    assert written.where("customer_id = 7").select("file").distinct().count() >= 4
    in_file = written.withColumn("row", F.col("_metadata.row_index")).orderBy("file", "row").collect()
    keys = [(r["file"], r["customer_id"], -r["order_purchase_timestamp"].timestamp(), r["_id"]) for r in in_file]
    assert keys == sorted(keys)


def test_newest_orders_from_the_layout(spark, shop, built):
    documents = build.read_documents(spark, built[0]).documents
    customer = shop.orders.groupBy("customer_id").count().orderBy(F.desc("count"), "customer_id").first()[0]
    found = [r["order_purchase_timestamp"] for r in orders_of_customer(documents, customer).collect()]
    assert found == sorted(found, reverse=True) and len(found) > 1
    plan = orders_of_customer(documents, customer)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(customer_id,{customer})" in plan


def test_report_is_written_through_the_file_system(spark, shop, tmp_path):
    from orderloom.plans.report import write_report

    path = str(tmp_path / "report.md")
    write_report(spark, "# Größe\n", path)
    assert open(path, encoding="utf-8").read() == "# Größe\n"


def test_shared_folder_is_the_one_the_session_names(spark):
    assert staging.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    settled = staging.settle(spark.range(5))
    assert settled.count() == 5
    assert os.listdir(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_tables_are_cleared_together(spark):
    folder = staging.scratch(spark, "some")
    spark.range(3).write.parquet(folder)
    assert folder != staging.scratch(spark, "some") and spark.read.parquet(folder).count() == 3
    staging.clear(spark)
    assert not os.path.exists(folder)
