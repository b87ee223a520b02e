import itertools
import random

from tabweave.llm.quotas import draw_sample, quotas, shortfalls, solve_quotas

ROWS = "row_id bigint, dataset_id bigint, load_no int, row_no int, site_code string, churn_risk string"
TARGETS = "request_id bigint, dataset_id bigint, load_no int, sample_size int, min_per_class int, class_label string, target_share double"


def test_flow_is_the_cheapest():
    """Against all integer quotas of small networks: shortfalls are the least there can be, and so is what strata take beyond their share."""
    r = random.Random(5)
    for seed in range(60):
        needs = {c: (r.randint(0, 2), r.randint(0, 4)) for c in "ab"}
        cells = {(c, k): r.randint(1, 3) for c in "ab" for k in "xy" if r.random() < 0.9}
        if not cells:
            continue
        quota, short = solve_quotas(needs, cells, seed)
        have = {c: sum(n for (a, _), n in cells.items() if a == c) for c in needs}
        assert short == {c: max(0, max(needs[c]) - have[c]) for c in needs}
        assert all(0 <= quota[ck] <= n for ck, n in cells.items())
        for c in needs:
            assert sum(q for (a, _), q in quota.items() if a == c) == min(have[c], max(needs[c]))
        total, whole = sum(max(v) for v in needs.values()), sum(cells.values())
        share = {k: total * sum(n for (_, b), n in cells.items() if b == k) / whole for k in "xy"}

        def beyond(q, lim):
            return sum(max(0, sum(v for (_, b), v in q.items() if b == k) - lim[k]) for k in "xy")

        bounds = [{"x": int(share["x"]) + i, "y": int(share["y"]) + j} for i in (0, 1) for j in (0, 1)]
        options = [dict(zip(cells, v)) for v in itertools.product(*[range(n + 1) for n in cells.values()])]
        fair = [o for o in options if all(sum(v for (a, _), v in o.items() if a == c) == min(have[c], max(needs[c])) for c in needs)]
        assert any(beyond(quota, b) == min(beyond(o, b) for o in fair) for b in bounds)


def test_sample(spark):
    rows = [(i, 1, 1, i, f"S{i % 3}", ["Low", " low", "HIGH", "n/a"][i % 4]) for i in range(400)]
    rows += [(1000 + i, 1, 1, i, f"S{i % 3}", ["Low", " low", "HIGH", "n/a"][i % 4]) for i in range(40)]
    targets = [(1, 1, 1, 50, 5, "Low", 0.5), (1, 1, 1, 50, 5, "High", 0.45), (1, 1, 1, 50, 5, "UNKNOWN", 0.05), (2, 1, 1, 500, 0, "Low", 0.5), (2, 1, 1, 500, 0, "Critical", 0.001), (3, 9, 1, 10, 1, "Low", 1.0), (4, 1, 1, 3, 0, "Low", 0.5), (5, 1, None, 4, None, "Low", None), (6, 1, 1, None, -3, "Low", float("nan"))]
    r, t = spark.createDataFrame([(*x, "e") for x in rows], ROWS + ", label string"), spark.createDataFrame([(*x, 1) for x in targets], TARGETS + ", need int")
    drawn = draw_sample(r, t).collect()
    count = lambda q, c: len({x.row_no for x in drawn if (x.request_id, x.class_label) == (q, c)})
    assert (count(1, "Low"), count(1, "High"), count(1, "UNKNOWN"), count(2, "Low"), count(4, "Low")) == (25, 23, 5, 200, 2)
    assert len(drawn) == 25 + 23 + 5 + 200 + 2 == len({(x.request_id, x.row_no) for x in drawn})
    s = {(x.request_id, x.class_label): (x.need, x.have, x.short) for x in shortfalls(quotas(r, t)).collect()}
    assert s == {(2, "Low"): (250, 200, 50), (2, "Critical"): (1, 0, 1), (3, "Low"): (10, 0, 10)}
    sites = {k: sum(1 for x in drawn if x.request_id == 1 and x.row_no % 3 == k) for k in range(3)}
    assert max(sites.values()) - min(sites.values()) <= 2
    assert quotas(r.limit(0), t.limit(0)).count() == 0 and draw_sample(r, t.limit(0)).count() == 0


def test_rows_of_a_cell_are_equally_likely(spark):
    r = spark.createDataFrame([(i, 1, 1, i, "S", "Low") for i in range(20)], ROWS)
    t = spark.createDataFrame([(q, 1, 1, 5, 0, "Low", 1.0) for q in range(400)], TARGETS)
    seen = [x["count"] for x in draw_sample(r, t).groupBy("row_no").count().collect()]
    assert len(seen) == 20 and sum(seen) == 2000 and min(seen) > 60 and max(seen) < 140
