from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.operators.records import cut_record, parse_records, sniff_separator

HEAD = "applicant_id,applicant_name,annual_income,credit_score,debt_ratio,applied_on,loan_approved"
COLS = "record_id bigint, upload_id bigint, record_no int, raw_text string"


def run(spark, texts, head=HEAD):
    df = spark.createDataFrame([(0, 1, 1, head)] + [(i, 1, i + 1, t) for i, t in enumerate(texts, 1)], COLS)
    return {r.record_id: r for r in parse_records(df).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from('ab",\n '), max_size=8), min_size=1, max_size=6))
def test_round_trip(fields):
    text = ",".join('"' + f.replace('"', '""') + '"' if set(f) & set('",\n') else f for f in fields)
    assert cut_record(text, ",") == (False, fields)


def test_reasons(spark):
    r = run(spark, [
        'A1,"Doe, J",5,600,0.5,2024-01-31,1', 'A2,"Doe,5,600,0.5,2024-01-31,1', 'A3,"Doe"x,5,600,0.5,2024-01-31,1', "A4,Doe,5,600,0.5,2024-01-31", 'A5,D 5",$1,600,0.5,2024-02-30,1',
        "A6,D,12k,600,0.5,2024-01-31,1", 'A7,"a\nb","$1,234.50",(5),44%,na,1', " \t ", None, "", "A8,D,1e,1,1,2024-01-31,1", "A9,D,-,?,NaN,,1", "A10,D,1e3,1.5E-2,.5,2024-1-05,1"])
    assert {k: v.reason for k, v in r.items()} == {1: None, 2: "broken_quoting", 3: "broken_quoting", 4: "column_count", 5: "invalid_value", 6: "invalid_value", 7: None, 11: "invalid_value", 12: None, 13: "invalid_value"}
    assert (r[7].annual_income, r[7].credit_score, r[7].debt_ratio, r[7].applied_on, r[7].applicant_name) == (1234.5, -5.0, 0.44, None, "a\nb")
    assert r[5].reason_column == "applied_on" and r[5].raw_kept.startswith("A5") and r[1].raw_kept is None


def test_header_order_separator_bom(spark):
    r = run(spark, ["1|600|x|A1|2024-01-31|5|0.5"], "\ufeffloan_approved|credit_score|applicant_name|applicant_id|applied_on|annual_income|debt_ratio")
    assert r[1].reason is None and r[1].credit_score == 600 and r[1].applicant_id == "A1"
    assert sniff_separator('"a,b";"c,d";e') == ";"


def test_no_header_empty_and_clashes(spark):
    df = spark.createDataFrame([(1, 9, 2, "a,b", "keep", 5)], COLS + ", reason string, _sep int")
    out = parse_records(df)
    r = out.first()
    assert r.reason_ == "no_header" and r.reason == "keep" and r._sep == 5
    assert parse_records(spark.createDataFrame([], COLS)).count() == 0


def test_very_long_and_repeated(spark):
    long = "A,D,1,1,1,2024-01-31," + "y" * 200_000
    wide = "," * 30_000
    many = '"' + '""' * 50_000 + '",D,1,1,1,2024-01-31,1'
    r = run(spark, [long, wide, many])
    assert [r[i].reason for i in (1, 2, 3)] == [None, "column_count", None] and len(r[3].applicant_id) == 50_000
    df = spark.createDataFrame([(0, 1, 1, HEAD), (0, 1, 1, HEAD), (5, 1, 2, "x"), (5, 1, 2, "x")], COLS)
    assert [x.reason for x in parse_records(df).collect()] == ["column_count"] * 2
