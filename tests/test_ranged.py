"""Ranged tables: rank, key and group reads against a sorted list, and what they open."""

import random

import pytest
from pyspark.sql import functions as F

import orderloom as ol
from checks.layout import scanned_rows
from orderloom.operators import serving
from orderloom.operators.access import first_of_built_mart
from orderloom.operators.contracts import MARTS
from orderloom.operators.ranged import PLACE, RANGE, DuplicateKeyError, RangedTable, _in_files, write_ranged
from orderloom.plans import build

KINDS = "_id bigint, status string, n bigint"


def written(spark, tmp_path, rows, **how):
    path = str(tmp_path / "t")
    assert write_ranged(spark.createDataFrame(rows, KINDS).repartition(3), path, **how) == len(rows)
    return RangedTable(spark, path)


def ids(frame):
    return [r["_id"] for r in frame.collect()]


def in_order(rows):
    return sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))


def hot_rows(n=900):
    chance = random.Random(4)
    rows = [(77, chance.choice("ab"), i) for i in range(n // 2)] + [(None, "a", i) for i in range(n // 6)]
    return rows + [(chance.randrange(200), chance.choice("abc"), i) for i in range(n - len(rows))]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Half of the rows have one key, a sixth none."""
    rows = hot_rows()
    return rows, written(spark, tmp_path_factory.mktemp("hot"), rows, ranges=6, block_rows=32)


@pytest.mark.parametrize("skip", [0, 7, 149, 150, 300, 595, 880, 899, 900, 5_000])
def test_pages_by_rank(hot, skip):
    rows, table = hot
    assert ids(table.at_rank(skip, 20)) == in_order(rows)[skip : skip + 20]


def test_pages_do_not_overlap_within_a_key(hot):
    rows, table = hot
    seen = [(r["_id"], r["status"], r["n"]) for skip in range(0, 900, 100) for r in table.at_rank(skip, 100).collect()]
    assert len(set(seen)) == len(rows) == len(seen)


def test_a_hot_key_spreads_over_ranges(hot):
    _, table = hot
    sizes = {r[RANGE]: r["count"] for r in table.placed().groupBy(RANGE).count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 3 * 900 / 6
    assert table.placed().where("_id = 77").select(RANGE).distinct().count() >= 3


@pytest.mark.parametrize("last", [None, "", -5, 0, 50, 76, 77, 150, 198, 500])
def test_pages_after_a_key(hot, last):
    rows, table = hot
    rest = in_order(rows) if last in (None, "") else [k for k in in_order(rows) if k is not None and k > last]
    assert ids(table.after(last, 30)) == rest[:30]


@pytest.mark.parametrize("key", [77, 5, 150, -1, 10_000, None])
def test_lookup(hot, key):
    rows, table = hot
    held = sum(r[0] == key for r in rows) if key is not None else 0
    assert ids(table.equal(key)) == [key] * min(1, held)
    assert ids(table.equal(key, limit=60)) == [key] * min(60, held)


def test_ranks_within_groups(spark, tmp_path):
    rows = hot_rows(300) + [(i, None, i) for i in range(20)]
    table = written(spark, tmp_path, rows, group="status", ranges=4, block_rows=16)
    for status in "abc":
        own = in_order([r for r in rows if r[1] == status])
        assert table.total(status) == len(own)
        for skip in (0, 13, 60, len(own) - 3, len(own)):
            assert ids(table.at_rank(skip, 10, status)) == own[max(0, skip) : max(0, skip) + 10]
        assert ids(table.after(76, 10, group=status)) == [k for k in own if k is not None and k > 76][:10]
    assert table.total("zz") == 0 and ids(table.at_rank(0, 5, "zz")) == []
    with pytest.raises(ValueError):
        table.at_rank(0, 5)


def test_places(spark, hot):
    _, table = hot
    rows = table.placed().withColumn("file", F.col("_metadata.file_name")).sample(0.05, seed=3).collect()
    some = {(r["file"], r[RANGE], r[PLACE]): r["n"] for r in rows}
    file = rows[0]["file"]
    found = table.at_places([*some, (file, 0, 10**6), (file, 99, 0)])
    assert {(r[RANGE], r[PLACE]): r["n"] for r in found.collect()} == {k[1:]: n for k, n in some.items()}
    assert table.at_places([]).count() == 0


@pytest.mark.parametrize("extra", [[], [(None, "a", 1)], [(1, "a", 1), (2, "b", 1)]])
def test_unique_keys(spark, tmp_path, extra):
    rows = [(i, "a", i) for i in range(500)] + [(None, "a", 0)]
    if not extra:
        assert written(spark, tmp_path, rows, ranges=5, block_rows=16, unique=True).total() == 501
        return
    with pytest.raises(DuplicateKeyError, match=f"^{len(extra)} rows"):
        written(spark, tmp_path, rows + extra, ranges=5, block_rows=16, unique=True)


def test_repeats_across_blocks_are_counted(spark, tmp_path):
    with pytest.raises(DuplicateKeyError, match="^549 rows"):
        written(spark, tmp_path, [(7, "a", i) for i in range(550)] + [(8, "a", 1)], ranges=5, block_rows=16, unique=True)


def test_bad_bounds(hot):
    for call in (lambda t: t.at_rank(-1, 5), lambda t: t.at_rank(0, 0), lambda t: t.after(3, 0), lambda t: t.equal(3, limit=0)):
        with pytest.raises(ValueError):
            call(hot[1])


def test_a_deep_page_reads_one_block(spark, tmp_path):
    path = str(tmp_path / "deep")
    # One key holds half of the rows.
    rows = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(200_000).alias("_id"), F.col("id").alias("n"))
    write_ranged(rows, path, ranges=8, block_rows=1_000)
    table = RangedTable(spark, path)
    for skip in (0, 150_000, 250_000, 399_990):
        page = table.at_rank(skip, 20)
        assert len(page.collect()) == min(20, 400_000 - skip)
        assert scanned_rows(page) <= 2_000


# -- a build ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(spark, small_folder):
    return ol.bind(spark, small_folder)


@pytest.fixture(scope="module")
def built(spark, shop, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("access"))
    ol.build_all(shop, folder)
    return folder


def test_access_equals_reads_of_the_whole_table(spark, built):
    access = build.order_access(spark, built)
    documents = build.read_documents(spark, built).documents
    for number, status in ((1, None), (3, None), (2, "delivered"), (1, "canceled"), (40, "shipped")):
        ours, whole = access.page(number, 15, status), serving.orders_page(documents, number, 15, status)
        assert (ours.total, ours.page, ours.size, ours.total_pages) == (whole.total, whole.page, whole.size, whole.total_pages)
        assert ours.items.collect() == whole.items.collect()
        assert ours.items.schema == documents.schema
    for last in (None, 5, 10**9):
        assert access.after(last, 10).collect() == serving.page_after(documents, last=last, limit=10).collect()
        expected = serving.page_after(documents, last=last, limit=10, filters={"order_status": "delivered"}).collect()
        assert access.after(last, 10, "delivered").collect() == expected
    for key in (10, 11, -1):
        assert access.by_id(key).collect() == serving.by_key(documents, key).collect()
    for customer in (r[0] for r in documents.select("customer_id").distinct().limit(5).collect()):
        assert access.of_customer(customer, 7).collect() == serving.orders_of_customer(documents, customer, 7).collect()
    with pytest.raises(ValueError):
        access.page(status="lost")


@pytest.mark.parametrize("name", MARTS)
def test_first_rows_of_built_marts_open_one_file(spark, shop, built, name):
    table = build.ranged_table(spark, built, name)
    found = first_of_built_mart(table, name, 10)
    assert found.collect() == serving.first_of_mart(ol.run(name, shop), name, 10).collect()
    assert len(table.at_rank(0, 10).inputFiles()) == 1


def test_blocks_are_joined_by_range_and_not_all_in_one_task(spark):
    """A task that coalesced the ranges held the joined offsets once for each of them."""
    ranges = spark.range(40, numPartitions=8).selectExpr("id % 8 as range_", "40 - id as low")
    known = spark.range(8).selectExpr("id as range_", "id * 100 as offset")
    joined = ranges.join(F.broadcast(known), "range_").selectExpr("low", "offset + low as before")
    listed = _in_files(joined, 40, ["before"])
    assert "Coalesce" not in listed._jdf.queryExecution().executedPlan().toString()
    found = [[r["before"] for r in part] for part in listed.rdd.glom().collect()]
    assert [len(part) for part in found if part] == [40]
    assert found[0] == sorted(100 * (i % 8) + 40 - i for i in range(40))
