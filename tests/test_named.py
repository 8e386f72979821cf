"""One named file for a table."""

import csv

import pytest
from pyspark.sql import functions as F

from quillspark.sources.named import write_named


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_rows_come_in_order_from_many_partitions(spark, tmp_path):
    df = spark.range(5000, numPartitions=7).withColumn("t", F.when(F.col("id") % 3 == 0, F.concat(F.lit('a "b", c\nd '), F.col("id")))).orderBy(F.desc("id"))
    path = str(tmp_path / "table.csv")
    write_named(df, path)
    rows = read(path)
    assert rows[0] == ["id", "t"] and rows[1:] == [[str(i), f'a "b", c\nd {i}' if i % 3 == 0 else ""] for i in range(4999, -1, -1)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table.csv"]


def test_the_file_is_replaced_and_may_be_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t.csv"
    write_named(spark.range(3), path)
    write_named(spark.range(0).withColumn("é", F.lit("x")), path, "all")
    assert (tmp_path / "t.csv").read_text(encoding="utf-8") == "id,é\n"
    write_named(spark.range(1).withColumn("v", F.lit(1.5)), path, "all")
    assert (tmp_path / "t.csv").read_text(encoding="utf-8") == 'id,v\n"0","1.5"\n'


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "t.csv"
    write_named(spark.range(3), str(path))
    broken = spark.range(100, numPartitions=5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_named(broken, str(path))
    assert read(path) == [["id"], ["0"], ["1"], ["2"]] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.csv"]
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).write.format("named_csv").option("path", str(path)).mode("append").save()
