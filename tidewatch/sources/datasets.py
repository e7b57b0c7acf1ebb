"""Files of the two public datasets and of the unified table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.operators.harmonize import nsl_standardize, union_datasets, unsw_standardize
from tidewatch.sources.schemas import NSL_SCHEMA, UNSW_SCHEMA, unsw_schema


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop))


def read_nsl_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless connection records; the 43 names and types are declared."""
    return spark.read.schema(NSL_SCHEMA).option("header", False).csv(path)


def nsl_from_csv(line: Column) -> Column:
    return F.from_csv(line, NSL_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def read_unsw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered flow records.  Only the header line is looked at to order the declared types."""
    header = spark.read.text(path).first()[0].lstrip("﻿").split(",")
    schema = unsw_schema([name.strip() for name in header])
    # a file of the folder with other names, or another order, is an error and not misread
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def unsw_from_csv(line: Column) -> Column:
    return F.from_csv(line, UNSW_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def optional_source(spark: SparkSession, read, train: str, test: str):
    """(train, test) frames, or None when either file is missing."""
    if path_exists(spark, train) and path_exists(spark, test):
        return read(spark, train), read(spark, test)
    return None


def load_datasets(spark: SparkSession, nsl: tuple[str, str], unsw: tuple[str, str]):
    """Unified (train, test) from whichever datasets are present; none at all is an error."""
    sources = [
        (optional_source(spark, read_nsl_csv, *nsl), nsl_standardize),
        (optional_source(spark, read_unsw_csv, *unsw), unsw_standardize)]
    pairs = [[standardize(part) for part in found] for found, standardize in sources if found]
    if not pairs:
        raise FileNotFoundError("no dataset was processed")
    return union_datasets(*[p[0] for p in pairs]), union_datasets(*[p[1] for p in pairs])


def write_unified_table(unified: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist the table, one folder per dataset (Parquet) or plain CSV with a header."""
    if fmt == "csv":
        unified.write.option("header", True).csv(path)
    else:
        unified.write.partitionBy("dataset").parquet(path)


def read_unified_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame | None:
    """The table, or None when it was never written."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
