"""Tables in and out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.sources import io

DAYS = [dt.date(2000, 1, 15), dt.date(2000, 2, 10), dt.date(2000, 3, 31)]


@pytest.fixture
def path(spark, tmp_path):
    rows = [(7.0, DAYS[0], 1.5, "a"), (8.0, DAYS[1], float("nan"), "b"), (float("nan"), DAYS[2], float("inf"), None)]
    df = spark.createDataFrame(rows, "id double, date date, x double, s string")
    io.write_table(df, f"{tmp_path}/t", ["id"])
    return f"{tmp_path}/t"


def test_read_within_dates_and_typed(spark, path):
    df = io.read_table(spark, path, "2000-02-01", "2000-12-31", columns=["id", "date", "x"], month_end=True, kinds={"id": "bigint"})
    assert dict(df.dtypes) == {"id": "bigint", "date": "date", "x": "double"}
    assert sorted(map(tuple, df.collect()), key=str) == [(8, dt.date(2000, 2, 29), None), (None, DAYS[2], None)]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        io.read_table(spark, path, columns=["nothing"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.read_table(spark, path, kinds={"s": "bigint"}).collect()


def test_only_what_is_asked_is_scanned(spark, path):
    plan = io.read_table(spark, path, "2000-02-01", columns=["date", "x"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2000-02-01)]" in plan and "ReadSchema: struct<date:date,x:double>" in plan


def test_pages(spark):
    df = spark.range(10).repartition(3)
    assert [r.id for r in io.page(df, ["id"], 3, 4).collect()] == [3, 4, 5, 6]
    assert [r.id for r in io.page(df, ["id"], 8).collect()] == [8, 9] and io.page(df, ["id"], 20, 1).count() == 0


def test_single_precision_partitions_and_csv(spark, path, tmp_path):
    df = io.read_table(spark, path)
    io.write_table(df.withColumn("y", F.year("date")), f"{tmp_path}/p", partition=["y"], single=True)
    assert dict(spark.read.parquet(f"{tmp_path}/p").dtypes)["x"] == "float" and spark.read.parquet(f"{tmp_path}/p").where("y = 2000").count() == 3
    io.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == df.columns


def test_slices_and_mapping(spark, tmp_path):
    assert io.date_slices(1990, 1996, 3) == [("1990-01-01", "1992-12-31"), ("1993-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31")]
    (tmp_path / "m.csv").write_text("function,jkp,ghz\nat_gr1,at_gr1,agr\nbe_me,be_me,\n")
    assert io.read_mapping(spark, f"{tmp_path}/m.csv", "ghz") == {"at_gr1": "agr"} and io.read_mapping(spark, f"{tmp_path}/m.csv", "jkp") == {"at_gr1": "at_gr1", "be_me": "be_me"}
