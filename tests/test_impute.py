import random
from datetime import datetime, timedelta

from tabweave.operators.impute import filled_cells, impute

COLS = "row_id bigint, dataset_id bigint, load_no int, site_code string, account_age_months double, monthly_charges double, usage_hours double, support_tickets double, contract_type string, churn_risk string, observed_at timestamp"
FIELDS = ["account_age_months", "monthly_charges", "usage_hours", "support_tickets", "contract_type"]


def test_sources_masks_and_target(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, 1, 1, "S1", 10.0, 5.0, 1.0, 0.0, "One-Year", "Low", t), (2, 1, 1, "S1", None, float("nan"), -3.0, 1.0, " n/a", None, t), (3, 1, 1, None, None, 7.0, 2.0, 1.0, "one-year", "High", t),
        (4, 1, 1, "S2", None, 7.0, 2.0, 1.0, None, "High", t + timedelta(days=400)), (5, 2, 1, "S1", None, 1.0, 1.0, 1.0, "One-Year", "Low", None), (5, 2, 1, "S1", None, 1.0, 1.0, 1.0, "One-Year", "Low", None)]
    got = impute(spark.createDataFrame(rows, COLS))
    by = {r.row_id: r for r in got.collect()}
    assert got.count() == 6 and "churn_risk_filled" not in got.columns and by[2].churn_risk is None
    assert (by[2].account_age_months_source, by[2].monthly_charges_source, by[2].usage_hours_source, by[2].contract_type_source) == ("group",) * 4
    assert by[2].account_age_months_filled == 10.0 and by[2].contract_type_filled == "One-Year" and by[2].support_tickets_source is None
    assert by[3].account_age_months_source == "time" and by[4].account_age_months_source == "dataset" and by[5].account_age_months_source == "all"
    assert all(r[f"{c}_filled"] is not None for r in by.values() for c in FIELDS)


def test_empty_and_fields_without_values(spark):
    assert impute(spark.createDataFrame([], COLS)).count() == 0
    none = spark.createDataFrame([(i, 1, 1, "S", None, None, 1.0, 1.0, None, None, None) for i in range(3)], COLS)
    assert [r.monthly_charges_filled for r in impute(none).collect()] == [None] * 3
    assert filled_cells(impute(none), "row_id", FIELDS).count() == 0


def test_equations_beat_group_means(spark):
    r, rows, hidden = random.Random(3), [], {}
    for i in range(4000):
        age = r.gauss(50, 10)
        kind = r.random() < 1 / (1 + 2.7 ** ((50 - age) / 4))
        charge = 20 + 1.5 * age + r.gauss(0, 2)
        hide = i % 7 == 0
        if hide:
            hidden[i] = charge
        rows.append((i, 1, 1 + i % 2, f"S{i % 5}", age, None if hide else charge, 5.0 + r.random(), 1.0, (None if i % 11 == 0 else "two-year" if kind else "month"), "Low", datetime(2024, 1, 1)))
        if i % 11 == 0:
            hidden[-i - 1] = "two-year" if kind else "month"
    done = {x.row_id: x for x in impute(spark.createDataFrame(rows, COLS)).collect()}
    err = [(done[i].monthly_charges_filled - v) for i, v in hidden.items() if i >= 0]
    spread = (sum(e * e for e in err) / len(err)) ** 0.5
    assert spread < 6 and spread > 1.5  # group means alone leave 15; drawn residuals keep about twice the noise
    kinds = [done[-i - 1].contract_type_filled == v for i, v in hidden.items() if i < 0]
    assert sum(kinds) / len(kinds) > 0.65


def test_same_result_however_partitioned(spark):
    rows = [(i, 1, 1, "S", None if i % 3 == 0 else float(i % 10), float(i % 7), 1.0 * (i % 5), 1.0, None if i % 4 == 0 else "ab"[i % 2], "Low", datetime(2024, 1, 1)) for i in range(200)]
    a, b = (sorted(map(str, impute(spark.createDataFrame(rows, COLS).repartition(n), decimals={"account_age_months": 6}).collect())) for n in (1, 7))
    assert a == b


def test_clashing_names(spark):
    rows = [(1, 1, 1, "S", None, 1.0, 1.0, 1.0, "a", "b", None, "k", 1.5), (2, 1, 1, "S", 4.0, 1.0, 1.0, 1.0, "a", "b", None, "k", 1.5)]
    out = impute(spark.createDataFrame(rows, COLS + ", key string, account_age_months_filled double"))
    r = out.where("row_id = 1").first()
    assert r.key == "k" and r.account_age_months_filled == 1.5 and r.account_age_months_filled_ == 4.0


def test_rare_labels_are_filled_in(spark):
    """With room for one class, a group whose labels are all rarer ones gets one of its own."""
    cols = "row_id bigint, dataset_id bigint, load_no int, site_code string, observed_at timestamp, account_age_months double, monthly_charges double, usage_hours double, support_tickets double, contract_type string, churn_risk string"
    when = datetime(2024, 1, 1)
    rows = [(i, 1, 1, "A", when, 1.0, 2.0, 3.0, 4.0, "Common", "Low") for i in range(60)]
    rows += [(100 + i, 1, 2, "B", when, 1.0, 2.0, 3.0, 4.0, ["Rare one", "Rare two", None][i % 3], "Low") for i in range(30)]
    done = impute(spark.createDataFrame(rows, cols), most_labels=1).where("load_no = 2 AND contract_type IS NULL").collect()
    assert len(done) == 10 and {r.contract_type_filled for r in done} <= {"Rare one", "Rare two"} and {r.contract_type_source for r in done} == {"group"}


def test_figures_that_are_not_broadcast(spark, monkeypatch):
    """The plan of many groups, in which rows meet their group by a shuffle, fills the same."""
    from tabweave.plans import physical

    d = spark.read.parquet("/root/testdata/sf0.001/churn_rows.parquet")
    want = {tuple(r) for r in impute(d, keep=["row_id"]).collect()}
    monkeypatch.setattr(physical, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in impute(d, keep=["row_id"]).collect()} == want
