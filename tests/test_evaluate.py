"""Encoders, experiments and what is said of synthetic tables."""

import numpy as np
from pyspark.sql import functions as F

from tabweave.operators import augment, describe, evaluate, fidelity, synth


def test_encoder_knows_only_its_rows(spark):
    train = spark.createDataFrame([(1, 1.0, "a", 9.0), (2, 3.0, "b", 9.0), (3, None, "a", 9.0), (4, float("nan"), None, 9.0), (5, 8.0, "", 9.0)], "id int, x double, c string, k double")
    e = evaluate.fit_encoder(train, ["id", "x", "k"], ["c"], ["id"])
    assert e.numbers[0][:2] == ("x", 3.0) and e.numbers[1] == ("k", 9.0, 9.0, 1.0) and e.labels == (("c", "a", ("a", "b")),) and e.columns == ["e0", "e1", "e2", "e3"]
    got = [tuple(r) for r in evaluate.encode(spark.createDataFrame([(1, 4.0, "z", None), (2, None, None, 10.0)], train.schema), e, ["id"]).collect()]
    assert got[0][1] == 0.0 and got[0][2:] == (0.0, 0.0, 0.0) and abs(got[1][1] + 1 / np.std([1, 3, 8], ddof=1)) < 1e-12 and got[1][2:] == (1.0, 1.0, 0.0)
    empty = evaluate.fit_encoder(train.limit(0), ["x"], ["c"])
    assert evaluate.encode(train, empty, ["id"]).where("e0 IS NULL").count() == 0 and evaluate.encode(train, evaluate.Encoder((), ()), ["id"]).first().e0 == 0.0


def test_split_and_splice(spark):
    d = spark.range(10).selectExpr("id", "id % 2 AS y", "id * 2 AS x")
    f, y = evaluate.split_target(d, "y", "id")
    assert evaluate.splice_target(f, y, "id", "y", d.columns).orderBy("id").collect() == d.orderBy("id").collect()
    s = {r.id: r.is_test for r in evaluate.sequential_split(d, "id", 0.3).collect()}
    assert s == {i: i >= 7 for i in range(10)}


def test_new_rows_have_ids_of_their_own(spark):
    """A neighbour search over augmented rows lets every new row vote once."""
    d = spark.range(60).select(F.col("id").alias("rid"), F.when(F.col("id") < 50, "a").otherwise("b").alias("y"), F.when(F.col("id") < 50, F.col("id")).otherwise(1000 + F.col("id")).cast("double").alias("x"))
    seen = []

    def more(train, seed):
        seen.append(augment.oversample(train, "y", "rid", ["x"], seed=seed))
        return seen[-1]

    p = evaluate.controlled_predictions(d, "rid", "y", ["x"], {"baseline": None, "more": more}, runs=2, kind="knn")
    assert p.groupBy("strategy", "run", "rid").count().where("count > 1").count() == 0 and p.where("actual != predicted").count() == 0 and len(seen) == 2
    m = evaluate.averaged_confusion(p).where("strategy = 'more'").collect()
    assert {(r.actual, r.predicted): r.n for r in m} == {("a", "a"): 13.0, ("b", "b"): 3.0}
    assert {r.impact for r in evaluate.recall_impact(p).collect()} == {"unchanged"}
    t = evaluate.metrics_table(evaluate.grouped_metrics(p, ["strategy", "run"]), "e", "knn")
    assert len(t.columns) == 15 and {r.strategy: r.verdict for r in t.collect()} == {"baseline": "Baseline", "more": "Marginal"}
    assert {r.better for r in evaluate.compare_experiments(t, t).collect()} == {"same"}


def test_grouped_metrics_are_those_of_each_group(spark):
    r = np.random.default_rng(3)
    p = spark.createDataFrame([("s", int(i % 3), "abc"[int(a)], "abcd"[int(b)]) for i, (a, b) in enumerate(zip(r.integers(0, 3, 300), r.integers(0, 4, 300)))], "strategy string, run int, actual string, predicted string")
    whole = {x.run: tuple(x)[2:] for x in evaluate.grouped_metrics(p, ["strategy", "run"]).collect()}
    # A mean of four-digit figures may lie half-way between two four-digit ones, and then falls to either.
    assert all(np.allclose(whole[k], tuple(evaluate.summary_metrics(p.where(f"run = {k}")).first()), rtol=0, atol=1.01e-4) for k in range(3))


def test_tstr_in_order(spark):
    d = spark.range(40).select(F.col("id"), F.when(F.col("id") % 2 == 0, "e").otherwise("o").alias("y"), (F.col("id") % 2).cast("double").alias("x"))
    t = evaluate.tstr(d, d.withColumn("id", F.col("id") + 100), "id", "y", numbers=["x"], in_order=True).first()
    assert (t.baseline_accuracy, t.synthetic_accuracy, t.retention, t.verdict) == (1.0, 1.0, 100.0, "VIABLE_NEUTRAL")


def test_synthesis_quality(spark):
    r = np.random.default_rng(1)
    a = r.normal(0, 1, (300, 2))
    frame = lambda x: spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(x)], "id long, x double, y double")
    same = augment.synthesis_quality(frame(a), frame(a), "id", "id", ["x", "y"]).first()
    assert (same.correlation_fidelity, same.distribution_fidelity, same.diversity, same.redundancy) == (1.0, 1.0, 80, 100.0)
    b = r.normal(3, 2, (120, 2))
    q = augment.synthesis_quality(frame(a), frame(b), "id", "id", ["x", "y"]).first()
    spread = lambda x: np.mean([np.sqrt(((u - v) ** 2).sum()) for i, u in enumerate(x) for v in x[i + 1 :]])
    assert q.diversity == int(np.floor(min(100, 80 * spread(b[:50]) / spread(a[:50])) + 0.5))
    d = np.sqrt((((b[:, None] - a[None]) / (a.max(0) - a.min(0))) ** 2).sum(2) / 2).min(1)
    assert q.redundancy == round(100 * (d < 0.05).mean(), 1)
    gap = abs(np.corrcoef(a.T)[0, 1] - np.corrcoef(b.T)[0, 1])
    assert abs(q.correlation_fidelity - max(0, 1 - gap)) < 1e-3 and q.distribution_fidelity == max(0.0, round(1 - 2 * np.mean([x.d for x in fidelity.ks(frame(a), frame(b), ["x", "y"]).collect()]), 4))
    assert augment.synthesis_quality(frame(a), frame(b[:1]), "id", "id", ["x", "y"]).first().diversity == 50


def test_service_copula(spark):
    r = np.random.default_rng(2)
    a = r.normal(0, 1, 2000)
    d = spark.createDataFrame([(i, float(np.round(u, 2)), float(np.round(0.8 * u + 0.6 * v, 2)), "xy"[int(u > 0)]) for i, (u, v) in enumerate(zip(a, r.normal(0, 1, 2000)))], "id long, a double, b double, c string")
    new = synth.synthesize(d, "copula_service", 1500, "id", ["a", "b"], ["c"])
    p = new.toPandas()
    assert len(p) == 1500 and p.notna().all().all() and abs(np.corrcoef(p.a, p.b)[0, 1] - 0.8) < 0.06
    assert new.join(d.select("a").distinct(), "a", "left_anti").count() == 0 and fidelity.ks(d, new, ["a", "b"]).agg(F.max("d")).first()[0] < 0.06


def test_service_audit_has_its_parts(spark):
    d = spark.range(50).selectExpr("id", "double(id % 7) AS x", "double(id) AS y")
    w = fidelity.audit_service_whole(d, d, "id", "id", ["x", "y"]).first()
    assert (w.dcr_score, w.zero_memorization_rate, w.columns, w.ks_p_mean) == (0.0, 0.0, 2, 1.0)


def test_profile_of_an_empty_table_and_of_odd_columns(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "na", None)], "n int, s string, t timestamp")
    columns, whole = describe.dataset_profile(d)
    assert {r.column_name: (r.data_type, r.null_count) for r in columns.collect()} == {"n": ("numeric", 0), "s": ("categorical", 1), "t": ("datetime", 2)}
    assert (whole.first().cells, whole.first().missing, whole.first().missing_pct) == (6, 3, 50.0)
    assert describe.dataset_profile(d.limit(0))[1].first().rows == 0
    counts, need = describe.retarget(spark.range(30).selectExpr("double(id) AS x", "id % 3 AS y", "id % 2 AS z"), "z", ["x"])
    assert counts.count() == 2 and need.first().ratio == 1.0
