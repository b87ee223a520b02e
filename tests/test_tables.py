"""Fixed vectors and statistical properties of the table operators."""

import json
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tabweave.functions.rng import normal_cdf, probit, uniform
from tabweave.functions.scalars import clean_number, parse_datetime, sql_literal, strict_number
from tabweave.operators import describe, evaluate, fidelity, relations, synth
from tabweave.operators.order import melt, order_statistics, quantiles, running_counts
from tabweave.plans.physical import dense_rank_within
from tabweave.sources import Catalog, normalize_headers, read_csv, read_json, sniff
from tabweave.sources.export import safe_columns, safe_table, sql_schema


def vec(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_outlier_vector(spark):
    r = describe.outliers(vec(spark, [10, 12, 14, 15, 18, 20, 22, 100]), ["x"]).first()
    assert (r.lower, r.upper, r["count"]) == (3.0, 31.0, 1)


def test_ks_and_wasserstein_vectors(spark):
    a, b, c = vec(spark, [10, 12, 14, 15, 16, 18, 20]), vec(spark, [10, 12, 14, 15, 16, 18, 20]), vec(spark, range(100, 131, 5))
    assert fidelity.ks(a, b, ["x"]).first().d == 0 and fidelity.ks(a, c, ["x"]).first().d == 1
    assert fidelity.wasserstein(a, b, ["x"]).first().w1 == 0 and fidelity.wasserstein(a, c, ["x"]).first().w1 >= 80
    tied, single = vec(spark, [1, 1]), vec(spark, [1])
    assert fidelity.ks(tied, single, ["x"]).first().d == 0.5 and fidelity.ks(tied, single, ["x"], "exact").first().d == 0


def test_confusion_vector(spark):
    p = spark.createDataFrame([("cat", "cat"), ("cat", "dog"), ("dog", "dog"), ("dog", "dog"), ("bird", "bird")], "actual string, predicted string")
    m = {r.label: r for r in evaluate.class_metrics(p).collect()}
    assert (m["cat"].tp, m["cat"].fn, m["cat"].fp, m["cat"].tn) == (1, 1, 0, 3)


def test_normal_functions(spark):
    r = spark.range(1).select(probit(F.lit(0.5)).alias("a"), probit(F.lit(0.975)).alias("b"), normal_cdf(F.lit(0.0)).alias("c"), probit(F.lit(0.05)).alias("d"), uniform(42, F.lit(7), 0).alias("u")).first()
    assert abs(r.a) < 1e-3 and abs(r.b - 1.96) < 0.02 and abs(r.c - 0.5) < 1e-6 and abs(r.d + 1.645) < 1e-3 and r.u == 0.8428191791754216


def test_cells(spark):
    cells = ["$5,200.50", "12%", "", "(123.45)", "1d", "0x10", "1e3", "1,234.5", "N/A"]
    r = spark.createDataFrame([(c,) for c in cells], "s string").select("s", clean_number(F.col("s")).alias("c"), strict_number(F.col("s")).alias("n"), sql_literal(F.col("s")).alias("q")).collect()
    assert [x.c for x in r] == [5200.5, 12.0, None, -123.45, None, None, 1000.0, 1234.5, None]
    assert [x.n for x in r] == [None, None, None, None, None, None, 1000.0, 1234.5, None]
    assert r[2].q == "NULL" and r[0].q == "'$5,200.50'" and r[6].q == "1e3"
    dates = ["2024-01-31", "2024-01-31T10:20:30Z", "2024-02-31", "31/01/2024", "01/31/2024", "Jan 31 2024", "2024", "2024-01-31 10:20:30+02:00"]
    got = [x.t for x in spark.createDataFrame([(d,) for d in dates], "s string").select(F.date_format(parse_datetime(F.col("s")), "yyyy-MM-dd HH:mm").alias("t")).collect()]
    assert got == ["2024-01-31 00:00", "2024-01-31 10:20", None, "2024-01-31 00:00", "2024-01-31 00:00", "2024-01-31 00:00", None, "2024-01-31 08:20"]


def test_order_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(0, 50, 3000), np.zeros(1500), [1e12, -1e12]]), 2)
    long = melt(vec(spark, x), ["x"])
    q = quantiles(long, [0.0, 0.1, 0.5, 0.9, 1.0]).first()
    assert np.allclose([q[f"q{i}"] for i in range(5)], np.quantile(x, [0, 0.1, 0.5, 0.9, 1.0]))
    s = order_statistics(long, {"n": F.lit(1)}, {"n": F.array(*[F.lit(k).cast("bigint") for k in (0, 7, 2250, len(x) - 1)])})
    assert [r.n for r in s.orderBy("i").collect()] == [float(np.sort(x)[k]) for k in (0, 7, 2250, len(x) - 1)]
    assert running_counts(long, {"n": F.lit(1)}).agg(F.max("n_upto")).first()[0] == len(x)
    assert quantiles(melt(vec(spark, []), ["x"]), [0.5]).count() == 0


def test_hot_group_rank(spark):
    df = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS k")
    r = dense_rank_within(df, ["k"], [F.col("id")], "n").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert all(x.c == x.d == x.m for x in r)


def test_copula_keeps_marginals_and_correlation(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(u), float(v), 999.0, "xy"[int(u > 0)]) for u, v in zip(a, np.exp(0.8 * a + 0.6 * rng.normal(size=3000)))], "a double, b double, k double, c string")
    new = synth.copula(df, ["a", "b", "k"], ["c"], 3000).toPandas()
    assert set(new.k) == {999.0} and abs(new.a.mean()) < 0.1 and abs(np.corrcoef(new.a, np.log(new.b))[0, 1] - 0.8) < 0.07 and set(new.c) <= {"x", "y"}
    assert fidelity.ks(df, spark.createDataFrame(new), ["a", "b"]).agg(F.max("d")).first()[0] < 0.06


def test_bayes_network_keeps_dependence(spark):
    rows = [(float(i % 10), "hi" if i % 10 >= 5 else "lo") for i in range(2000)]
    new = synth.bayes_network(spark.createDataFrame(rows, "x double, c string"), ["x"], ["c"], 2000, bins=10)
    wrong = new.where("(x < 4.4 AND c = 'hi') OR (x > 5.5 AND c = 'lo')").count()
    assert new.count() == 2000 and wrong < 40


def test_cholesky():
    m = np.array([[1, 0.9, 0.2], [0.9, 1, 0.9], [0.2, 0.9, 1]])  # not positive definite
    low = synth.cholesky_psd(m)
    assert np.allclose(np.diag(low @ low.T), 1, atol=1e-6)
    r = np.array([[1, 0.5], [0.5, 1]])
    assert np.allclose(synth.cholesky_psd(r) @ synth.cholesky_psd(r).T, r, atol=1e-6)


def test_mutual_information_of_copies(spark):
    df = spark.createDataFrame([(i % 4, f"v{i % 4}", i % 3) for i in range(1200)], "a int, b string, c int")
    mi = {(r.a, r.b): r.mi for r in relations.mutual_information(df, ["a", "b", "c"]).collect()}
    assert abs(mi["a", "b"] - np.log(4)) < 1e-6 and mi["a", "c"] < 1e-3


def test_files(spark):
    d = Path(tempfile.mkdtemp())
    (d / "a.csv").write_text('CustomerID;Pay;Pay;;When\nC1;"$5,200.50";1;x;2024-01-31\n;;;;\nC2;"1,000";2;"a\n""b""";2024-02-01\nC3;7;3\n')
    t = read_csv(spark, str(d / "a.csv"))
    assert t.columns == ["CustomerID", "Pay", "Pay_1", "column_4", "When"] and t.count() == 3
    assert dict(t.dtypes)["Pay_1"] == "double" and dict(t.dtypes)["When"] == "timestamp" and t.where("CustomerID = 'C2'").first()["column_4"] == 'a\n"b"'
    for i, doc in enumerate(([{"a": 1, "b": {"c": 2}}, {"b": None, "z": "q"}], [["a", "b"], [1, 2]], {"headers": ["a"], "rows": [[1], [2]]}, {"records": [{"a": 1}]})):
        (d / f"{i}.json").write_text(json.dumps(doc))
    assert read_json(spark, str(d / "0.json")).columns == ["a", "b", "z"] and read_json(spark, str(d / "0.json")).first().b == '{"c": 2}'
    assert [read_json(spark, str(d / f"{i}.json")).count() for i in (1, 2, 3)] == [1, 2, 1]
    assert normalize_headers(["a", "a", " ", "a"]) == ["a", "a_1", "column_3", "a_2"] and sniff(["a|b", "1|2"], "client") == "|"


def test_catalog_and_names(spark):
    c = Catalog(spark, tempfile.mkdtemp())
    c.put("one", spark.range(3), "me", "First 100%")
    c.put("two", spark.range(5), "me", "Second")
    assert [r.id for r in c.list("me", "100%").collect()] == ["one"] and c.delete("one") and not c.delete("none")
    assert [r.id for r in c.list().collect()] == ["two"]
    assert safe_table("__My Table!") == "my_table_" and safe_columns(["1st", "", "A b"]) == ["col_1st", "col_2", "a_b"]
    assert '"id" BIGINT' in sql_schema(spark.range(5).withColumn("id", F.col("id") + 5), "t")


def test_models_on_the_sample(spark):
    from tabweave.sources import benchmark_table, churn_sample

    d = churn_sample(spark, 1500)
    assert {r.label: r.n for r in describe.class_counts(d, "churn_risk").collect()}["Low"] > 900 and d.where("monthly_charges = 245").count() == 1
    s = evaluate.stratified_split(d, "churn_risk", "id")
    numbers = ["account_age_months", "monthly_charges", "usage_hours", "support_tickets"]
    for kind in ("decision_tree", "logistic_regression", "random_forest", "knn"):
        m = evaluate.summary_metrics(evaluate.fit_predict(s.where("NOT is_test"), s.where("is_test"), "id", "churn_risk", numbers, kind)).first()
        assert m.accuracy > 0.8, kind
    assert {r.label: r.n for r in describe.class_counts(benchmark_table(spark), "churn_risk").collect()} == {"High": 28, "Medium": 56, "Low": 196}


def test_action_log_and_script(spark):
    from tabweave.sources import ActionLog

    log = ActionLog(spark, tempfile.mkdtemp() + "/log")
    assert log.note("me", "upload", "x", details={"rows": 3}) and log.read().first().details == '{"rows": 3}'
    compile(evaluate.script("t.parquet", "y", ["a"], "decision_tree", "oversample"), "s", "exec")
