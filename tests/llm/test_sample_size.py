import random

from tabweave.llm.quotas import draw_sample, fair_parts, quotas, sample_report, solve_sample

ROWS = "row_id bigint, dataset_id bigint, load_no int, row_no int, site_code string, churn_risk string"
TARGETS = "request_id bigint, dataset_id bigint, load_no int, sample_size int, min_per_class int, class_label string, target_share double"


def test_a_sample_keeps_its_size(spark):
    rows = spark.createDataFrame([(i, 1, 1, i, f"S{i % 3}", ["Low", " low", "HIGH", "n/a"][i % 4]) for i in range(400)], ROWS)
    targets = spark.createDataFrame([(1, 1, 1, 50, 5, "Low", 0.5), (1, 1, 1, 50, 5, "High", 0.45), (1, 1, 1, 50, 5, "UNKNOWN", 0.05), (2, 1, 1, 8, 5, "Low", 0.9), (2, 1, 1, 8, 5, "High", 0.1), (3, 1, 1, 150, 0, "Low", 0.1), (3, 1, 1, 150, 0, "Critical", 0.9)], TARGETS)
    got = {(r.request_id, r.class_label): r for r in sample_report(quotas(rows, targets, keep_size=True)).collect()}
    assert {k: r.got for k, r in got.items()} == {(1, "Low"): 23, (1, "High"): 22, (1, "UNKNOWN"): 5, (2, "Low"): 5, (2, "High"): 5, (3, "Low"): 15, (3, "Critical"): 0}
    assert got[1, "Low"].given_up == 2 and got[1, "High"].given_up == 1 and got[1, "Low"].over == 0 and got[2, "Low"].over == 2 and got[3, "Critical"].short == 135
    drawn = [(r.request_id, r["count"]) for r in draw_sample(rows, targets, keep_size=True).groupBy("request_id").count().orderBy("request_id").collect()]
    assert drawn == [(1, 50), (2, 10), (3, 15)]
    assert sample_report(quotas(rows.limit(0), targets.limit(0), keep_size=True)).count() == 0


def test_random_requests(spark):
    r = random.Random(9)
    for seed in range(300):
        needs = {c: (r.randint(0, 4), r.randint(0, 9)) for c in "abcd"[: r.randint(1, 4)]}
        cells = {(c, k): r.randint(1, 6) for c in needs for k in "xyz" if r.random() < 0.7}
        have = {c: sum(n for (a, _), n in cells.items() if a == c) for c in needs}
        size = r.randint(0, 25)
        quota, short, given = solve_sample(needs, cells, seed, size)
        got = {c: sum(q for (a, _), q in quota.items() if a == c) for c in needs}
        can = {c: min(max(needs[c]), have[c]) for c in needs}
        floors = {c: min(needs[c][0], have[c]) for c in needs}
        assert all(0 <= q <= cells[ck] for ck, q in quota.items()) and all(floors[c] <= got[c] <= can[c] for c in needs)
        assert sum(got.values()) == max(min(size, sum(can.values())), sum(floors.values()))
        assert all(max(needs[c]) == got[c] + short[c] + given[c] and given[c] >= 0 for c in needs)


def test_fair_parts():
    assert fair_parts({"a": 20, "b": 18, "c": 0}, 35) == {"a": 18, "b": 17, "c": 0} and fair_parts({"a": 1}, 5) == {"a": 1} and fair_parts({}, 0) == {} and fair_parts({"a": 3, "b": 3}, 1) == {"a": 1, "b": 0}
