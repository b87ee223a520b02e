"""Random tables with a hot load, ties, repeated rows and missing values of all kinds: the operators against their SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd

from tabweave.core_queries import ORACLES
from tabweave.operators.impute import filled_cells, impute
from tabweave.operators.quality import column_defects
from tabweave.operators.records import parse_records
from tests.compare import plain

NUMBERS = ["account_age_months", "monthly_charges", "usage_hours", "support_tickets"]
CHURN = "row_id bigint, dataset_id bigint, load_no int, row_no int, account_id string, site_code string, plan_code string, account_age_months double, monthly_charges double, usage_hours double, support_tickets double, contract_type string, churn_risk string, observed_at timestamp"
PROFILES = "dataset_id bigint, load_no int, column_name string, null_count bigint, min_value double, max_value double"


def churn(seed, n=3000):
    r, rows = random.Random(seed), []
    for i in range(n):
        d, l = (1, 2) if r.random() < 0.4 else (r.randint(1, 6), r.choice([1, 2, 3, 5]))
        x = [r.choice([None, float("nan"), -1.0]) if r.random() < 0.05 * l else round(r.gauss(40 + 6 * l, 12), r.choice([0, 1, 2])) * (100 if r.random() < 0.002 else 1) for _ in NUMBERS]
        t = lambda good: r.choice([None, "", " N/A", "?", "-"]) if r.random() < 0.1 else good
        rows.append((i, d, l, i % 900, t(f"AC-{r.randint(1, 50):03d}" if r.random() > 0.01 else "ac 1"), t(f"S{r.randint(1, 4)}"), t("A1-X"), *x, t(r.choice(["One-Year", "one-year ", "Two-Year"])), t(r.choice(["Low", "\tLOW", "High"][: 2 + (l > 2)])), datetime(2024, 1, 1) + timedelta(hours=i)))
    return rows + rows[:50]


def sql(query, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted((tuple(map(plain, r)) for r in con.execute(query).fetchall()), key=repr)


def frame(rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    f = pd.DataFrame(rows, columns=names)
    for c in schema.split(", "):
        name, kind = c.split()
        f[name] = f[name].astype({"string": "string", "double": "float64", "bigint": "int64", "int": "int32"}.get(kind, "datetime64[us]"))
    return f


def test_defects(spark):
    for seed in (1, 2):
        rows = churn(seed)
        profiles = [(d, l, c, n, lo, 1e9) for d in range(1, 7) for l in (1, 2, 3, 5) for c, n, lo in (("usage_hours", 3, 0.0), ("plan_code", 10, None))]
        df, stored = spark.createDataFrame(rows, CHURN), spark.createDataFrame(profiles, PROFILES)
        got = sorted((tuple(map(plain, r)) for r in column_defects(df, stored).select("dataset_id", "load_no", "column_name", "issue").collect()), key=repr)
        nan_as_null = "(SELECT * REPLACE (CASE WHEN isnan(min_value) THEN NULL ELSE min_value END AS min_value, CASE WHEN isnan(max_value) THEN NULL ELSE max_value END AS max_value) FROM column_profiles)"
        want = sql(ORACLES["p1_found"].replace("JOIN column_profiles q", f"JOIN {nan_as_null} q"), churn_rows=frame(rows, CHURN), column_profiles=frame(profiles, PROFILES))
        assert got == want and len(got) > 20


def test_filled_cells(spark):
    rows = churn(3)
    done = impute(spark.createDataFrame(rows, CHURN))
    got = sorted((tuple(map(plain, r)) for r in filled_cells(done, "row_id", [*NUMBERS, "contract_type"]).where("source = 'group'").select("row_id", "column_name").collect()), key=repr)
    assert got == sql(ORACLES["p3_found"], churn_rows=frame(rows, CHURN)) and len(got) > 500
    assert done.count() == len(rows)


def test_records(spark):
    r, rows, i = random.Random(9), [], 0
    names = ["applicant_id", "applicant_name", "annual_income", "credit_score", "debt_ratio", "applied_on", "loan_approved"]
    for u in range(1, 25):
        sep, order = r.choice(",;\t|"), r.sample(names, 7)
        rows.append((i, u, 1, sep.join(order)))
        for k in range(2, 80):
            i += 1
            good = {"applicant_id": "A1", "applicant_name": r.choice(['"D, J"', '"a ""b"" c"', "Doe", '"x\ny"']), "annual_income": r.choice(["5", "$5.5", '"1,234"', "(3)", "1e", "na"]), "credit_score": "600", "debt_ratio": r.choice(["5%", ".5", "x"]), "applied_on": r.choice(["2024-01-31", "2024-02-30", "?", "2024-1-1"]), "loan_approved": r.choice(["1", ""])}
            text = sep.join(good[n] for n in order)
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                at = r.randint(0, len(text))
                text = text[:at] + r.choice(['"', sep, "\n", "x", " ", '""']) + text[at + r.randint(0, 1) :]
            rows.append((i, u, k, text))
        i += 1
    got = sorted((tuple(x) for x in parse_records(spark.createDataFrame(rows, "record_id bigint, upload_id bigint, record_no int, raw_text string")).where("reason IS NOT NULL").select("record_id", "reason").collect()), key=repr)
    raw = pd.DataFrame(rows, columns=["record_id", "upload_id", "record_no", "raw_text"])
    want = sorted((tuple(x) for x in duckdb.connect().register("raw_records", raw).execute(ORACLES["p2_found"]).fetchall()), key=repr)
    texts = {x[0]: x[3] for x in rows}
    assert [(*x, texts[x[0]]) for x in got if x not in want] == [(*x, texts[x[0]]) for x in want if x not in got]
    assert got == want and len({x[1] for x in got}) == 3
