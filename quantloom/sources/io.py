"""Tables in and out: Parquet, CSV, JDBC; panels with their attributes beside the data; names of characteristics."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import nan_to_null
from quantloom.operators.panel import Panel


@dataclass(frozen=True)
class Config:
    """Settings of a library run; names are columns or folders."""

    data_dir: str = "data"
    replicate_jkp: bool = False
    single_precision: bool = False
    mapping_file: str | None = None


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, date: str = "date", columns: list[str] | None = None, month_end: bool = False, kinds: dict[str, str] | None = None) -> DataFrame:
    """A Parquet table's rows within dates, which reach the scan; NaN and infinities as null. Missing columns are an error.

    kinds: column -> type; a value that isn't of its type is an error, as the table isn't what it should be.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    df = nan_to_null(df)
    if kinds:
        df = df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    return df.withColumn(date, F.last_day(date)) if month_end else df


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Some rows of a table in a stated order, of which its first columns should make a key."""
    df = df.orderBy(*order).offset(offset)
    return df if limit is None else df.limit(limit)


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, partition: list[str] | None = None, single: bool = False) -> None:
    if single:
        df = df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})
    df = df.sortWithinPartitions(*sort) if sort else df
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, date: str, slices: list[tuple[str, str]], **options: str) -> DataFrame:
    """A remote query in parallel slices of dates, both ends included; credentials come as options."""
    predicates = [f"{date} between date '{a}' and date '{b}'" for a, b in slices]
    return spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=options)


def date_slices(first: int, last: int, years: int) -> list[tuple[str, str]]:
    return [(f"{y}-01-01", f"{min(y + years - 1, last)}-12-31") for y in range(first, last + 1, years)]


def save_panel(panel: Panel, path: str, names: dict[str, str] | None = None) -> None:
    """The panel's data, columns renamed to their aliases, and its attributes as JSON beside it."""
    spark = panel.df.sparkSession
    write_table(panel.df.withColumnsRenamed(names or {}), f"{path}/data", [panel.id, panel.date])
    attributes = {k: getattr(panel, k) for k in ("id", "date", "freq", "base_freq")} | {"names": names or {}}
    spark.createDataFrame([(json.dumps(attributes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attributes")


def load_panel(spark: SparkSession, path: str) -> Panel:
    a = json.loads(spark.read.text(f"{path}/attributes").first()[0])
    df = spark.read.parquet(f"{path}/data").withColumnsRenamed({v: k for k, v in a.pop("names").items()})
    return Panel(df, **a)


def read_mapping(spark: SparkSession, path: str, alias: str) -> dict[str, str]:
    """Characteristic -> name under an alias column of a CSV table with a column `function`; rows without a name are left out."""
    rows = spark.read.option("header", True).csv(path).select("function", alias).na.drop().collect()  # one row for a characteristic
    return {r[0]: r[1] for r in rows}

