"""CSV and Parquet sources: dialect, types, splitting, errors, headers."""

import csv
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import dirty
import orderloom as ol
from orderloom.operators.loads import clean_dates, keyed, products_enriched
from orderloom.operators.quality import missing_values, profile
from orderloom.sources import reader
from orderloom.sources.catalog import DATASETS
from conftest import session_settings

FILES = {name: d.file_pattern.replace("*", "shop_") for name, d in DATASETS.items()}


def write(path, header, rows, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=ending)
        writer.writerow(header)
        writer.writerows(rows)


def write_shop(folder, tables, ending="\n"):
    for name, dataset in DATASETS.items():
        header = dataset.schema.names
        write(folder / FILES[name], header, [[r[c] for c in header] for r in tables[name]], ending)


@pytest.fixture(scope="module")
def tables():
    found = dirty.rows()
    # An empty text cannot be told from a missing one in a CSV file.
    for review in found["order_reviews"]:
        review["review_comment_message"] = review["review_comment_message"] or None
    return found


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv")
    write_shop(path, tables)
    return path


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_csv_round_trip(spark, folder, tables):
    expected = dirty.shop(spark, tables)
    read = ol.read_shop_csv(spark, str(folder))
    for name, dataset in DATASETS.items():
        assert read.table(name).schema.names == dataset.schema.names
        assert [f.dataType for f in read.table(name).schema] == [f.dataType for f in dataset.schema]
        assert same(read.table(name), expected.table(name)), name


def test_marts_from_csv_equal_marts_from_parquet(spark, folder, tmp_path):
    from_csv = ol.read_shop_csv(spark, str(folder))
    ol.land_parquet(from_csv, str(tmp_path))
    from_parquet = ol.read_shop_parquet(spark, str(tmp_path))
    for name in ("monthly_metrics", "customer_analytics"):
        assert same(ol.run(name, from_csv), ol.run(name, from_parquet))


def test_leading_zeros_and_quoted_breaks_survive(spark, tmp_path):
    header = DATASETS["customers"].schema.names
    write(tmp_path / FILES["customers"], header, [["c1", "u1", "01037", 'são "paulo", sp', ""]])
    row = reader.read_csv(spark, str(tmp_path), "customers").first()
    assert (row["customer_zip_code_prefix"], row["customer_city"], row["customer_state"]) == (
        "01037",
        'são "paulo", sp',
        None,
    )


def test_files_may_be_folders_of_parts(spark, tmp_path, tables):
    (tmp_path / FILES["sellers"]).mkdir()
    header = DATASETS["sellers"].schema.names
    for part in (1, 2):
        write(tmp_path / FILES["sellers"] / f"part{part}.csv", header, [[f"s{part}", "1", "c", "SP"]])
    assert {r["seller_id"] for r in reader.read_csv(spark, str(tmp_path), "sellers").collect()} == {"s1", "s2"}


def test_values_that_do_not_fit_are_errors_but_can_be_profiled(spark, tmp_path):
    header = DATASETS["orders"].schema.names
    bad = ["o1", "c1", "shipped", "2018-01-01 00:00:00", "yesterday", "  ", "", "2017-01-01 00:00:00"]
    write(tmp_path / FILES["orders"], header, [bad])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        reader.read_csv(spark, str(tmp_path), "orders").collect()
    text = reader.read_csv(spark, str(tmp_path), "orders", as_text=True)
    found = profile("orders", text).first().asDict()
    assert found["missing:order_approved_at"] == 0
    assert found["missing:order_delivered_carrier_date"] == found["missing:order_delivered_customer_date"] == 1
    assert found["date:approved before purchase"] == 0
    assert found["date:estimated before purchase"] == 1


def test_a_wrong_header_is_an_error(spark, tmp_path):
    write(tmp_path / FILES["sellers"], ["a", "b", "c", "d"], [["s", "1", "c", "SP"]])
    with pytest.raises(Exception, match="header|CSV"):
        reader.read_csv(spark, str(tmp_path), "sellers").collect()


def test_missing_files_are_all_named(spark, tmp_path, folder):
    assert reader.missing_datasets(spark, str(folder)) == []
    write(tmp_path / FILES["sellers"], DATASETS["sellers"].schema.names, [])
    with pytest.raises(FileNotFoundError) as error:
        ol.read_shop_csv(spark, str(tmp_path))
    assert all(name in str(error.value) for name in set(DATASETS) - {"sellers"})
    assert "sellers (" not in str(error.value)
    with pytest.raises(FileNotFoundError):
        reader.read_csv(spark, str(tmp_path), "orders")
    with pytest.raises(KeyError):
        reader.read_csv(spark, str(tmp_path), "geolocation")


def test_headers_and_types(spark, folder, tables):
    headers = {r["dataset"]: r for r in reader.csv_headers(spark, str(folder)).collect()}
    assert set(headers) == set(DATASETS)
    for name, dataset in DATASETS.items():
        assert headers[name]["columns"] == dataset.schema.names
        assert headers[name]["n_columns"] == len(dataset.schema.names)
    types = reader.column_types(ol.read_shop_csv(spark, str(folder))).where("dataset = 'order_payments'")
    assert [(r["column"], r["type"]) for r in types.orderBy("position").collect()] == [
        ("order_id", "string"),
        ("payment_sequential", "bigint"),
        ("payment_type", "string"),
        ("payment_installments", "bigint"),
        ("payment_value", "double"),
    ]


def test_inferred_types_for_comparison(spark, folder):
    inferred = reader.read_csv_inferred(spark, str(folder), "customers")
    assert inferred.schema["customer_zip_code_prefix"].dataType.simpleString() == "int"


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_line_breaks_in_texts_survive(spark, tmp_path, ending):
    texts = [None, "plain", "with, comma", 'says "hi"', "two\nlines", "a\r\nb", "\n", "a\n\n\nb", 'q"\n"q', "long\n" * 60]
    header = DATASETS["order_reviews"].schema.names
    folder = tmp_path / "all_order_reviews_dataset.csv"
    folder.mkdir()
    expected = {}
    for part in (1, 2):
        rows = [[f"r{part}-{i}", f"o{i % 9}", i % 5 + 1, "t", texts[i % len(texts)], datetime(2018, 1, 1), ""] for i in range(300)]
        expected |= {row[0]: row[4] for row in rows}
        write(folder / f"part-{part}.csv", header, rows, ending)
    if ending == "\r\n":  # Spark reads the line ends of such a file alike, inside quotes too
        expected = {key: text and text.replace("\r\n", "\n") for key, text in expected.items()}
    found = {r["review_id"]: r["review_comment_message"] for r in reader.read_csv(spark, str(tmp_path), "order_reviews").collect()}
    assert found == expected


def test_swapped_columns_are_an_error(spark, tmp_path):
    header = list(DATASETS["order_reviews"].schema.names)
    header[:2] = header[1::-1]
    write(tmp_path / "x_order_reviews_dataset.csv", header, [["o", "r", 1, "t", "m", datetime(2018, 1, 1), ""]])
    with pytest.raises(Exception, match="header"):
        reader.read_csv(spark, str(tmp_path), "order_reviews").collect()


def test_two_files_of_one_dataset_are_an_error(spark, tmp_path):
    for name in ("old", "new"):
        write(tmp_path / f"{name}_order_reviews_dataset.csv", DATASETS["order_reviews"].schema.names, [])
    with pytest.raises(ValueError, match="several"):
        reader.read_csv(spark, str(tmp_path), "order_reviews")


def test_key_renaming(spark):
    table = spark.createDataFrame([("s", "c")], "seller_id string, seller_city string")
    assert keyed(table, "seller_id").first().asDict() == {"seller_city": "c", "_id": "s"}


def test_enrichment_keeps_every_translation(spark):
    products = spark.createDataFrame([("p1", "a"), ("p2", None), ("p3", "z")], "product_id string, product_category_name string")
    names = spark.createDataFrame(
        [("a", "x"), ("a", "w"), (None, "n")], "product_category_name string, product_category_name_english string"
    )
    found = sorted(tuple(r) for r in products_enriched(products, names).collect() if r["product_id"] == "p1")
    assert found == [("p1", "a", "w"), ("p1", "a", "x")]
    assert products_enriched(products, names).where("product_category_name_english is null").count() == 2


def test_dates_are_cleaned_by_name_and_type(spark):
    table = spark.createDataFrame(
        [
            (datetime(2024, 5, 1).date(), "2024-01-01", "2024-01-01T10:00:00Z", "2024-01-01", "soon", "x"),
            (None, None, None, "2024-01-01", "2024-01-01", None),
        ],
        "day date, order_date string, order_timestamp string, plain string, sent_at string, note_at_all string",
    )
    cleaned = clean_dates(table)
    kinds = dict(cleaned.dtypes)
    assert kinds == {
        "day": "timestamp_ntz",
        "order_date": "timestamp_ntz",
        "order_timestamp": "timestamp_ntz",
        "plain": "string",
        "sent_at": "string",
        "note_at_all": "string",
    }
    first = cleaned.first()
    assert first["day"] == datetime(2024, 5, 1)
    assert first["order_timestamp"] == datetime(2024, 1, 1, 10)


def test_columns_are_pruned_at_the_scan(spark, folder, tmp_path):
    ol.land_parquet(ol.read_shop_csv(spark, str(folder)), str(tmp_path))
    shop = ol.read_shop_parquet(spark, str(tmp_path))
    plan = ol.run("monthly_metrics", shop)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:string,price:double,freight_value:double>" in plan
    assert "seller_id" not in plan and "shipping_limit_date" not in plan


def test_missing_values_as_text(spark, folder, tables):
    text = ol.read_shop_csv(spark, str(folder), as_text=True)
    found = {(r["dataset"], r["column"]): r["missing"] for r in missing_values(text).collect()}
    blank = sum(1 for r in tables["order_reviews"] if r["review_comment_title"] in (None, " "))
    assert found["order_reviews", "review_comment_title"] == blank


def _documents(spark, folder, files):
    rows = [(i, f'text {i}, "quoted"\nand a second line ' + "x" * 100, "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(files).write.parquet(f"{folder}/documents.parquet")
    return sorted((str(i), i % 5 + 1, lang, text) for i, text, lang in rows)


@pytest.mark.parametrize(("name", "in_files", "least"), [("texts_from_csv", 1, 1), ("texts_from_csv", 6, 6), ("texts_from_csv_split", 1, 27)])
def test_texts_go_through_as_many_files_as_the_table_needs(spark, tmp_path, monkeypatch, name, in_files, least):
    expected = _documents(spark, tmp_path, in_files)
    # About 27 KB of text: 27 files of 1,000 bytes, and no two input files in one partition.
    monkeypatch.setattr(registered, "FILE_BYTES", 1_000, raising=False)
    with session_settings(spark, {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}):
        result = registered.queries()[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in result.collect()) == expected
    assert len(result.inputFiles()) >= least


def test_landed_columns_that_drifted_are_an_error(spark, tmp_path, small_folder):
    folder = str(tmp_path / "landed")
    shop = ol.bind(spark, small_folder)
    tables = {name: reader.typed_like(table, name) for name, table in shop.tables().items()}
    ol.land_parquet(ol.Shop(**tables), folder)
    assert reader.landed_drift(spark, folder).count() == 0
    ol.read_shop_parquet(spark, folder)
    ol.land_parquet(ol.Shop(**(tables | {"sellers": tables["sellers"].withColumn("more", F.lit(1))})), folder)
    assert ol.read_shop_parquet(spark, folder).sellers.columns == tables["sellers"].columns
    renamed = tables["orders"].withColumnRenamed("customer_id", "client_id")
    ol.land_parquet(ol.Shop(**(tables | {"orders": renamed})), folder)
    with pytest.raises(reader.DriftError, match="orders.customer_id: missing"):
        ol.read_shop_parquet(spark, folder)
    retyped = tables["order_items"].withColumn("price", F.col("price").cast("string"))
    ol.land_parquet(ol.Shop(**(tables | {"order_items": retyped})), folder)
    with pytest.raises(reader.DriftError, match="order_items.price: string instead of double"):
        ol.read_shop_parquet(spark, folder)
