import tempfile

import pytest

from tabweave.functions.instants import read_instant
from tabweave.operators.timestamps import normalize_timestamps

CASES = [
    ("2024-01-31T10:20:30.5", "Europe/Berlin", "2024-01-31T09:20:30.500000Z"), ("2024-01-31 10:20:30.123456789z", None, "2024-01-31T10:20:30.123456Z"),
    ("20210929T181328", "Asia/Tokyo", "2021-09-29T09:13:28.000000Z"), ("08/19/2025 12:13:16", "Europe/London", "2025-08-19T11:13:16.000000Z"),
    ("03/04/2025", None, "2025-04-03T00:00:00.000000Z"), ("17 Apr 2021 8:13 am", "UTC", "2021-04-17T08:13:00.000000Z"), ("17 Apr 2021 12:13 AM", "UTC", "2021-04-17T00:13:00.000000Z"),
    ("Tue, 09 Jul 2024 21:47:21 +0100", "Asia/Tokyo", "2024-07-09T20:47:21.000000Z"), ("April 5, 2025", "America/New_York", "2025-04-05T04:00:00.000000Z"),
    ("2023-07-04 05:14:02 EDT", "Asia/Tokyo", "2023-07-04T09:14:02.000000Z"), ("2026-01-10T12:10:23[Europe/Berlin]", "America/New_York", "2026-01-10T11:10:23.000000Z"),
    ("2026-07-30T01:59:22+10:00[Australia/Sydney]", None, "2026-07-29T15:59:22.000000Z"), ("1705079730", "Asia/Tokyo", "2024-01-12T17:15:30.000000Z"), ("1657743091243", None, "2022-07-13T20:11:31.243000Z"),
    ("1714186300299764", None, "2024-04-27T02:51:40.299764Z"), ("2022-09-28T05:23:38+10", None, "2022-09-27T19:23:38.000000Z"), ("  2024-03-10 02:30:00-05:00 ", "America/New_York", "2024-03-10T07:30:00.000000Z"),
    ("2024-03-10 02:30:00", "America/New_York", "nonexistent"), ("2024-11-03T01:51:41.4", "America/Chicago", "ambiguous"), ("2024-11-03T01:51:41 EST", "America/Chicago", "2024-11-03T06:51:41.000000Z"),
    *[(v, None, "invalid") for v in ("2022-00-12", "13/13/2024", "soon", "2024", "99999", "31", "12:45", "2023-W14", "Feb 30 2024", "2024-03-05T10:20:30+25:00", "2023-08-08T11:22:60Z", "2024-01-01 25:00", "2024-01-01 10:00 XYZ", "2024-01-01T10:00[Mars/Base]", "13:00 pm", "17 Apr 2021 13:00 pm", "x" * 50_000)],
]


@pytest.mark.parametrize(("raw", "zone", "outcome"), CASES)
def test_read(raw, zone, outcome):
    assert read_instant(raw, zone) == outcome


def test_operator(spark):
    cols = "stamp_id bigint, raw_value string, zone_name string, outcome string, _raw string"
    rows = [(1, "2024-01-31T10:20:30.123456Z", None, "o", "r"), (2, " NaN ", None, "o", "r"), (3, None, "UTC", "o", "r"), (4, "31.01.2024", "  ", "o", "r"), (4, "31.01.2024", "  ", "o", "r"), (5, "2024-02-30T10:20:30.123456Z", None, None, None), (6, "2024-01-31T10:20:30.123456Z\n", None, None, None)]
    out = sorted(map(tuple, normalize_timestamps(spark.createDataFrame(rows, cols), "raw_value", "zone_name").select("stamp_id", "outcome_", "status").collect()))
    assert out == [(1, "2024-01-31T10:20:30.123456Z", "canonical"), (2, None, "missing"), (3, None, "missing"), (4, "2024-01-31T00:00:00.000000Z", "read"), (4, "2024-01-31T00:00:00.000000Z", "read"), (5, "invalid", "read"), (6, "2024-01-31T10:20:30.123456Z", "read")]
    assert normalize_timestamps(spark.createDataFrame([], cols), "raw_value", "zone_name").count() == 0


def test_dictionary_grows_only_by_new_strings(spark):
    path = tempfile.mkdtemp() + "/words"
    make = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, raw string")
    first = normalize_timestamps(make(["2024-01-01", "2024-01-02", "2024-01-01"]), "raw", None, path)
    assert first.count() == 3 and spark.read.parquet(path).count() == 2
    second = normalize_timestamps(make(["2024-01-02", "2024-01-03"]), "raw", None, path)
    assert sorted(r.micros for r in second.collect()) == [1704153600000000, 1704240000000000] and spark.read.parquet(path).count() == 3


def test_hot_string(spark):
    df = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, '2024-01-01', CAST(1600000000 + id AS STRING)) AS raw")
    assert normalize_timestamps(df, "raw").where("outcome IS NULL OR outcome = 'invalid'").count() == 0


def test_strings_appended_twice_double_no_rows(spark):
    path = tempfile.mkdtemp() + "/words"
    df = spark.createDataFrame([(1, "2024-01-01", "x"), (2, "2024-01-02", "x"), (3, "2024-01-01", "y"), (4, "2024-01-01", None)], "i int, raw string, src string")
    want = sorted(map(tuple, normalize_timestamps(df, "raw", dictionary=path, source=("src",)).collect()))
    words = spark.read.parquet(path + "/version=1")
    assert len(want) == 4 and words.count() == 4
    words.write.mode("append").parquet(path + "/version=1")
    assert sorted(map(tuple, normalize_timestamps(df, "raw", dictionary=path, source=("src",)).collect())) == want


def test_another_parser_reads_anew(spark, monkeypatch):
    from tabweave.operators import timestamps

    path = tempfile.mkdtemp() + "/words"
    df = spark.createDataFrame([("2024-01-01",)], "raw string")
    assert normalize_timestamps(df, "raw", dictionary=path).count() == 1
    monkeypatch.setattr(timestamps, "VERSION", 2)
    assert normalize_timestamps(df, "raw", dictionary=path).count() == 1 and spark.read.parquet(path + "/version=2").count() == 1
