"""Readers and sinks on temporary files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.operators import report
from tabsonde.sources import readers, sinks


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_csv(spark, tmp_path):
    df = readers.load(write(tmp_path / "a.csv", "id,name,sale_date\n1,가나,2024-01-02\n2,x,bad\n"), spark)
    assert df.schema["id"].dataType == T.IntegerType()
    assert [r.name for r in df.orderBy("id").collect()] == ["가나", "x"]
    prepared = readers.load_prepared(df.withColumn("sale_date", F.col("sale_date").cast("string")))
    got = [r.sale_date for r in prepared.orderBy("id").collect()]
    assert got[0].year == 2024 and got[1] is None


def test_csv_with_given_schema(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,v\n1,2\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    assert readers.read_csv(spark, path, schema).first() == (1, 2.0)


def test_csv_falls_back_to_cp949(spark, tmp_path):
    path = write(tmp_path / "k.csv", "id,name\n1,한글\n2,서울\n", "cp949")
    assert not readers.is_utf8(spark, path)
    df = readers.load(path, spark)
    assert [r.name for r in df.orderBy("id").collect()] == ["한글", "서울"]


def test_narrow_csv(spark, tmp_path):
    path = write(tmp_path / "n.csv", "a,b,c\n1,70000,0.5\n100,2,0.25\n")
    got = {f.name: f.dataType.simpleString() for f in readers.read_csv_narrow(spark, path).schema}
    assert got == {"a": "tinyint", "b": "int", "c": "float"}


def test_json(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert readers.load(path, spark).count() == 2


def test_bad_input(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        readers.load(write(tmp_path / "a.txt", "x"), spark)
    with pytest.raises(ValueError, match="empty"):
        readers.load(write(tmp_path / "e.csv", "a,b\n"), spark)
    with pytest.raises(ValueError):
        readers.load(3)


def test_cached(spark):
    df = readers.cached(spark.range(5))
    assert df.storageLevel.useMemory and df.storageLevel.useDisk
    df.unpersist()


def test_write_csv(spark, tmp_path):
    out = sinks.write_csv(spark.range(4).withColumn("t", F.lit("a,b")), str(tmp_path / "out"))
    back = readers.read_csv(spark, out)
    assert back.count() == 4 and back.first().t == "a,b"


def frame(spark):
    return spark.createDataFrame([(1, 2.0, "a"), (2, None, "a"), (2, None, "a"), (4, 9.0, "b")], "n int, v double, k string")


def test_reports(spark, tmp_path):
    df = frame(spark)
    path = sinks.quick_report(df, str(tmp_path / "quick"))
    back = spark.read.parquet(path)
    assert {r.part for r in back.select("part").distinct().collect()} == {"summary", "statistics", "charts", "insights"}
    config = report.ReportConfig(include_visualizations=False, include_insights=False)
    some = spark.read.parquet(sinks.detailed_report(df, str(tmp_path / "some"), config))
    assert {r.part for r in some.select("part").distinct().collect()} == {"summary", "statistics"}
    dup = some.where("metric = 'duplicate_rows'").first()
    assert dup.value == 1.0
    path = sinks.write_json_report(df, str(tmp_path / "json"), config)
    assert sorted(os.listdir(path)) == ["statistics", "summary"]
    assert spark.read.json(f"{path}/summary").where("metric = 'n_rows'").first().value == 4.0
    with pytest.raises(ValueError):
        report.report_tables(df, report.ReportConfig(include_summary=False, include_statistics=False,
                                                     include_visualizations=False, include_insights=False))


def test_cached_result_is_built_once(spark, tmp_path):
    src = str(tmp_path / "t.parquet")
    frame(spark).write.parquet(src)
    df = spark.read.parquet(src)
    calls = []

    def build():
        calls.append(1)
        return df.groupBy("k").count()

    key = sinks.result_key("counts", df, {"by": "k"})
    for _ in range(2):
        assert sinks.cached_result(str(tmp_path / "cache"), key, spark, build).count() == 2
    assert len(calls) == 1
    assert key == sinks.result_key("counts", df, {"by": "k"})
    assert key != sinks.result_key("counts", df, {"by": "n"})
    assert key != sinks.result_key("counts", df.where("n > 1"), {"by": "k"})
    df.write.mode("append").parquet(src)
    assert key != sinks.result_key("counts", spark.read.parquet(src), {"by": "k"})


def test_named_encoding_names_and_lines(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "t.csv", " a , b,a\n1,x,2\n")
    assert readers.load(path, spark).columns[1] == "b"
    monkeypatch.setattr(readers, "is_utf8", lambda *a: 1 / 0)
    assert readers.load(path, spark, encoding="UTF-8").count() == 1
    lines = write(tmp_path / "l.json", '{"a": 1}\n{"a": 2}\n')
    assert readers.load(lines, spark).count() == 2
    pretty = write(tmp_path / "p.json", json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert readers.load(pretty, spark, multi_line=True).count() == 2
    df = spark.createDataFrame([(1, 2)], "` x ` int, x int")
    assert readers.trimmed(df).columns == [" x ", "x"] and readers.trimmed(df.select("` x `")).columns == ["x"]
