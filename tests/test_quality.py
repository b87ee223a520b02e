from datetime import datetime
from statistics import stdev

from tabweave.operators.quality import Layout, column_defects, column_profile, drift_distances, form_counts, summaries
from tabweave.operators.quality import _pairs as pairs_of

COLS = "row_id bigint, dataset_id bigint, load_no int, account_id string, plan_code string, account_age_months double, monthly_charges double, usage_hours double, support_tickets double, contract_type string, churn_risk string"


def row(i, load, age=10.0, account="AC-1", plan="A1", contract="Low", risk="Low", charge=5.0):
    return (i, 1, load, account, plan, age, charge, 1.0, 0.0, contract, risk)


def found(spark, rows, stored=None, cols=COLS):
    return {tuple(r)[:4] for r in column_defects(spark.createDataFrame(rows, cols), stored).collect()}


def test_each_issue(spark):
    one = [row(i, 1) for i in range(20)]
    two = [row(100 + i, 3, age=None if i < 10 else 10.0, charge=500.0 if i == 0 else 5.0, account="AC-X" if i == 3 else "AC-1", risk="High" if i < 10 else " low") for i in range(20)]
    got = found(spark, one + two)
    assert got == {(1, 3, "account_age_months", "nulls"), (1, 3, "monthly_charges", "range"), (1, 3, "account_id", "shape"), (1, 3, "churn_risk", "drift")}


def test_stored_and_null_against_number(spark):
    stored = spark.createDataFrame([(1, 1, "account_age_months", 0, 10.0, 10.0), (1, 1, "monthly_charges", 1, 5.0, 5.0), (1, 1, "usage_hours", 0, None, 1.0), (1, 1, "plan_code", 0, None, None), (1, 9, "plan_code", 4, None, None)],
                                   "dataset_id bigint, load_no int, column_name string, null_count bigint, min_value double, max_value double")
    assert found(spark, [row(i, 1) for i in range(5)], stored) == {(1, 1, "monthly_charges", "stored"), (1, 1, "usage_hours", "stored")}


def test_empty_nulls_and_odd_numbers(spark):
    assert found(spark, []) == set()
    odd = [(1, None, 1, *[None] * 8), (2, 1, None, *[None] * 8), (3, 1, 1, None, "x" * 100_000, float("nan"), -1.0, float("inf"), 1e300, None, "?"), (4, 1, 2, None, None, None, None, None, None, None, None)]
    assert all(r[3] in ("nulls", "shape") for r in found(spark, odd))
    assert column_profile(spark.createDataFrame(odd, COLS)).count() == 16


def test_clashing_extra_columns(spark):
    rows = [(*row(i, 1), "x", 1, 2.0, "z") for i in range(5)]
    assert found(spark, rows, cols=COLS + ", g string, l int, x double, e string") == set()


def test_drift_is_exact_at_any_limit(spark):
    import random

    r = random.Random(1)
    rows = [row(i, 1 + i % 2, age=round(r.gauss(50 + 8 * (i % 2), 10), 1)) for i in range(600)]
    df, lay = spark.createDataFrame(rows, COLS), Layout()
    counts = form_counts(df, lay).select("g", "l", "c", "b", "f", "n", "lo", "hi").cache()
    s = summaries(counts, lay)
    p = pairs_of(counts, s)
    a, b = sorted(x[5] for x in rows if x[2] == 1), sorted(x[5] for x in rows if x[2] == 2)
    true = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    own = {x.c: x.distance for x in drift_distances(df, p, lay, None).collect()}
    assert abs(own[2] - true) < 1e-12
    for limit in (true - 0.01, true + 0.01, 0.05, 0.6):
        d = {x.c: x.distance for x in drift_distances(df, p, lay, limit).collect()}
        assert (d[2] > limit) == (true > limit)


def test_profile_moments(spark):
    values = [10, 12, 14, 15, 18, 20, 22, 100]
    rows = [row(i, 1, age=float(v)) for i, v in enumerate(values)]
    p = {r.column_name: r for r in column_profile(spark.createDataFrame(rows, COLS)).collect()}["account_age_months"]
    text = column_profile(spark.createDataFrame(rows, COLS)).where("column_name = 'plan_code'").first()
    assert (text["mean"], text["std"], text["skew"], text.distinct, text.top_form) == (None, None, None, 1, "A9")
    assert (p.rows, p.missing, p.distinct, p.min, p.max, p.inexact) == (8, 0, 8, 10.0, 100.0, 0)
    assert abs(p["mean"] - 26.375) < 1e-9 and abs(p["std"] - stdev(values)) < 1e-9 and p["skew"] > 2


def test_patterns(spark):
    lay = Layout(patterns={"plan_code": "A[0-9]"})
    rows = [row(1, 1), row(2, 1, plan="B1"), row(3, 1, plan=None)]
    p = {r.column_name: r.violations for r in column_profile(spark.createDataFrame(rows, COLS), lay).collect()}
    assert p["plan_code"] == 1 and p["account_id"] == 0


def test_datetime_columns_are_ignored(spark):
    rows = [(*row(1, 1), datetime(2024, 1, 1))]
    assert found(spark, rows, cols=COLS + ", observed_at timestamp") == set()


def moments_of(spark, values):
    """(mean, std, skew, kurtosis, inexact) of one column, and the same from whole numbers of any size."""
    from fractions import Fraction

    rows = [row(i, 1, age=float(v)) for i, v in enumerate(values)]
    p = column_profile(spark.createDataFrame(rows, COLS)).where("column_name = 'account_age_months'").first()
    x, n = [Fraction(float(v)) for v in values], len(values)
    mean = sum(x) / n
    m2, m3, m4 = (float(sum((v - mean) ** k for v in x)) for k in (2, 3, 4))
    skew = (n * (n - 1)) ** 0.5 / (n - 2) * (m3 / n) / (m2 / n) ** 1.5
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / n / (m2 / n) ** 2 - 3) + 6)
    return p, (float(mean), (m2 / (n - 1)) ** 0.5, skew, kurt)


def test_moments_far_from_zero(spark):
    import random

    r = random.Random(4)
    cases = [[99_999 + (i % 10) / 100 for i in range(1000)], [1.7e9 + i % 10 for i in range(1000)], [1e5 + round(r.gauss(0, 1), 6) for _ in range(300)], [1e-6 * r.randint(1, 9) for _ in range(300)],
             [1e9 + r.gauss(0, 1e-3) for _ in range(300)], [r.gauss(0, 1) * 1e-9 + 1e-6 for _ in range(300)], [r.choice([1.0, 2.0, 1e11]) for _ in range(300)], [1e13 + r.randint(0, 50) for _ in range(300)]]
    for values in cases:
        p, want = moments_of(spark, values)
        got = p["mean"], p["std"], p["skew"], p["kurtosis"]
        loose = 1e-5 if p.inexact else 1e-9
        assert all(abs(a - b) <= loose * max(1, abs(b)) for a, b in zip(got, want)), (values[:3], got, want)
        if not p.inexact:
            assert abs(p["std"] / want[1] - 1) < 1e-9
    assert [moments_of(spark, v)[0].inexact for v in cases[:3]] == [0, 0, 0]


def test_infinite_values_have_no_moments(spark):
    p = column_profile(spark.createDataFrame([row(1, 1, age=float("inf")), row(2, 1, age=3.0)], COLS)).where("column_name = 'account_age_months'").first()
    assert (p["max"], p["mean"], p["std"]) == (float("inf"), None, None) and p.inexact == 1
