"""Files in folders, names that meet, and tables that go from one catalog to another."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tabweave.sources import Catalog, export, read_csv, read_json
from tabweave.sources.readers import ragged_rows


def folder(**files):
    d = Path(tempfile.mkdtemp())
    for name, text in files.items():
        (d / name.replace("_", ".")).write_text(text)
    return str(d)


def test_a_folder_of_documents_has_the_rows_of_all(spark):
    d = folder(a_json=json.dumps([{"x": 1, "y": None}, {"x": 2}], indent=1), b_json=json.dumps({"headers": ["x", "x"], "rows": [[3, 4], [5]]}, indent=1))
    t = read_json(spark, d)
    assert sorted(map(str, (r.x for r in t.collect()))) == ["1", "2", "3", "5"] and set(t.columns) == {"x", "y", "x_1"} and t.where("x_1 = '4'").count() == 1


def test_json_lines(spark):
    d = folder(a_json='{"a": 1, "b": {"c": [1]}}\n\n{"b": "t"}\n', b_json='[{"a": 7}, {"a": 8}]\n')
    t = read_json(spark, d)
    assert set(t.columns) == {"a", "b"} and sorted(r.a or "" for r in t.collect()) == ["", "1", "7", "8"] and t.where("a = '1'").first().b == '{"c": [1]}'
    assert read_json(spark, folder(a_json="[]")).count() == 0
    try:
        read_json(spark, folder(a_json=" \n"))
    except ValueError as e:
        assert "EMPTY_JSON" in str(e)


def test_csv_without_line_breaks_is_split(spark):
    plain = read_csv(spark, folder(a_csv='a,b\n1,"x, y"\n2,z\n'))
    broken = read_csv(spark, folder(a_csv='a,b\n1,"x\ny"\n2,z\n'))
    assert [r.b for r in plain.orderBy("a").collect()] == ["x, y", "z"] and [r.b for r in broken.orderBy("a").collect()] == ["x\ny", "z"]


def test_ragged_records_with_quotes(spark):
    d = spark.createDataFrame([('a,"b,c"',), ("a,b,c",), ('a,"b',), ("a,b",)], "line string")
    assert ragged_rows(d, "line", ",", 2).first().ragged == 2


def test_names_that_meet(spark):
    assert export.safe_columns(["a b", "a-b", "A_b", "a_b_2"]) == ["a_b", "a_b_2", "a_b_3", "a_b_2_2"]
    text = export.sql_schema(spark.range(3).selectExpr("id AS `row key`", "id AS row_key"), "t")
    assert '"row_key" SERIAL' in text and '"row_key_2" BIGINT' in text and '"row_key_3" BIGINT' in text


def test_types_come_from_all_rows(spark):
    d = spark.range(2000).select(F.when(F.col("id") == 1999, "late text").otherwise(F.col("id").cast("string")).alias("v"))
    assert export.sql_types(d).first().sql_type == "VARCHAR(255)"


def test_structured_json(spark):
    d = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    text = "".join(r.line for r in export.json_structured(d, "k", "f.json", "2024-01-01T00:00:00.000Z").orderBy("place").collect())
    assert json.loads(text) == {"metadata": {"filename": "f.json", "exportedAt": "2024-01-01T00:00:00.000Z", "rowCount": 2, "columnCount": 2, "headers": ["k", "v"]}, "records": [{"k": 1, "v": None}, {"k": 2, "v": "b"}]}
    assert json.loads("".join(r.line for r in export.json_structured(d.limit(0), "k", "f", "t").orderBy("place").collect()))["records"] == []


def test_catalogs_exchange_tables(spark):
    a, b, path = Catalog(spark, tempfile.mkdtemp()), Catalog(spark, tempfile.mkdtemp()), tempfile.mkdtemp() + "/out"
    a.put("one", spark.range(3), "me", "First")
    a.put("two", spark.range(5), "you", "Second")
    assert a.update("one", name="Renamed") and not a.update("three") and [r.id for r in a.find(owner="me").collect()] == ["one"]
    a.export(path)
    assert b.take_in(path) == 2 and {r.name for r in b.list().collect()} == {"Renamed", "Second"} and b.get("two").count() == 5
    assert a.rollup().first().rows == 8 and a.clear() == 2 and a.list().count() == 0
