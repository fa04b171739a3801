"""Reading the catalog's datasets from a folder of CSV or Parquet files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.catalog import DATASETS, Dataset
from orderloom.sources.shop import Shop

CSV_DIALECT = {"header": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}

def _glob(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    filesystem = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(filesystem.globStatus(path) or [])


def _dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset: {name}")
    return DATASETS[name]


def missing_datasets(spark: SparkSession, folder: str, names: Iterable[str] = tuple(DATASETS)) -> list[str]:
    """Names of the datasets without a CSV file (or folder of part files) in ``folder``."""
    return [n for n in names if not _glob(spark, f"{folder}/{_dataset(n).file_pattern}")]


def require_datasets(spark: SparkSession, folder: str) -> None:
    missing = missing_datasets(spark, folder)
    if missing:
        listed = ", ".join(f"{n} ({DATASETS[n].file_pattern})" for n in missing)
        raise FileNotFoundError(f"missing in {folder}: {listed}")


def read_csv(
    spark: SparkSession,
    folder: str,
    name: str,
    as_text: bool = False,
) -> DataFrame:
    """One dataset with its declared types; a value that does not fit is an error.

    ``as_text`` keeps every column as text, so that profiling can look at values
    that do not fit. Reviews hold line breaks in quotes, so Spark reads each of their
    files in one task: deliver large ones as a folder of part files, and land them
    as Parquet once. Two matches of the dataset's pattern are an error, since an old
    and a new file would double the rows.
    """
    dataset = _dataset(name)
    path = f"{folder}/{dataset.file_pattern}"
    files = _glob(spark, path)
    if not files:
        raise FileNotFoundError(f"no file {dataset.file_pattern} in {folder}")
    if len(files) > 1:
        raise ValueError(f"several match {dataset.file_pattern}: " + ", ".join(str(f.getPath().getName()) for f in files))
    schema = dataset.text_schema if as_text else dataset.schema
    options = CSV_DIALECT | {"multiLine": dataset.multiline}
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(table: DataFrame, folder: str, name: str) -> None:
    """Write a dataset as CSV part files that :func:`read_csv` reads back unchanged."""
    file_name = _dataset(name).file_pattern.replace("*", "shop_")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.write.mode("overwrite").options(**options).csv(f"{folder}/{file_name}")


def read_csv_inferred(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One dataset with types inferred by Spark, to compare with the declared ones."""
    dataset = _dataset(name)
    options = {"header": True, "escape": '"', "multiLine": dataset.multiline, "inferSchema": True}
    return spark.read.options(**options, preferDate=False).csv(f"{folder}/{dataset.file_pattern}")


def read_shop_csv(spark: SparkSession, folder: str, as_text: bool = False) -> Shop:
    require_datasets(spark, folder)
    return Shop(**{name: read_csv(spark, folder, name, as_text) for name in DATASETS})


def land_parquet(shop: Shop, folder: str) -> None:
    """Write the role tables once as Parquet, so that marts read columns instead of CSV text."""
    for name, table in shop.tables().items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


class DriftError(ValueError):
    """Stored columns are not those of the catalog."""


def read_shop_parquet(spark: SparkSession, folder: str) -> Shop:
    """Role tables written by :func:`land_parquet`; a column that is missing or of another type is an error.

    Only footers are read for that. Without it a renamed column would arrive as NULLs,
    as the files are read with the catalog's schema. Further columns are left out.
    """
    problems = [f"{r['dataset']}.{r['column']}: {r['problem']}" for r in landed_drift(spark, folder).where("harmful").collect()]
    if problems:
        raise DriftError(f"in {folder}: " + "; ".join(problems))
    return Shop(**{name: spark.read.schema(d.schema).parquet(f"{folder}/{name}") for name, d in DATASETS.items()})


def landed_drift(spark: SparkSession, folder: str, names: Iterable[str] = tuple(DATASETS)) -> DataFrame:
    """``(dataset, column, problem, harmful)``: how the landed columns differ from the catalog's, by the files' footers."""
    rows = []
    for name in names:
        found = {f.name: f.dataType for f in spark.read.parquet(f"{folder}/{name}").schema.fields}
        declared = {f.name: f.dataType for f in _dataset(name).schema.fields}
        for column, kind in declared.items():
            if column not in found:
                rows.append((name, column, "missing", True))
            elif found[column] != kind:
                rows.append((name, column, f"{found[column].simpleString()} instead of {kind.simpleString()}", True))
        rows += [(name, column, "not in the catalog", False) for column in found if column not in declared]
    return spark.createDataFrame(rows, "dataset string, column string, problem string, harmful boolean")


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset, n_columns, columns)`` of every CSV present in ``folder``."""
    missing = set(missing_datasets(spark, folder))
    rows = []
    for name in sorted(set(DATASETS) - missing):
        pattern = f"{folder}/{DATASETS[name].file_pattern}"
        columns = spark.read.option("header", True).option("escape", '"').csv(pattern).columns
        rows.append((name, len(columns), columns))
    return spark.createDataFrame(rows, "dataset string, n_columns int, columns array<string>")


def column_types(shop: Shop) -> DataFrame:
    """``(dataset, position, column, type)`` of every role table."""
    rows = [
        (name, position, field.name, field.dataType.simpleString())
        for name, table in shop.tables().items()
        for position, field in enumerate(table.schema.fields, start=1)
    ]
    spark = shop.orders.sparkSession
    return spark.createDataFrame(rows, "dataset string, position int, column string, type string")


def typed_like(table: DataFrame, name: str) -> DataFrame:
    """All catalog columns of a dataset, cast to their types; absent columns become NULL."""
    schema = _dataset(name).schema
    return table.select(
        *[
            (F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
