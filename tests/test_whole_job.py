"""Queries and operators do the whole of their job: no window, row, value or column is left out."""

import pytest
from pyspark.sql import functions as F

from tabweave import core_queries, table_queries
from tabweave.operators import evaluate, synth
from tests.compare import SF, duck_rows, spark_rows


def table(spark, sf=SF):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def test_stream_has_all_windows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("window_start")
    whole = events.groupBy(day, "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    assert spark_rows(table_queries.stream_moments(spark, SF)) == spark_rows(whole)


def test_stream_over_a_folder_has_late_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    days = F.col("ts").cast("date") < "2024-01-03"
    late = events.where(days).withColumn("event_id", -F.col("event_id"))
    events.where(~days).unionByName(late).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    found = table_queries.stream_moments(spark, str(tmp_path))
    assert found.agg(F.sum("n")).first()[0] == events.where("value IS NOT NULL").count()


def test_stream_of_no_events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert table_queries.stream_moments(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["decision_tree", "logistic_regression", "random_forest", "knn"])
def test_models_score_a_quarter_of_all_churn_rows(spark, kind):
    rows = table(spark)("churn_rows")
    risk = F.lower(F.trim(F.translate("churn_risk", "\t", " ")))
    classes = {r.r: r["count"] for r in rows.where(risk.isin("low", "medium", "high")).groupBy(risk.alias("r")).count().collect()}
    found = table_queries._predicted(table(spark), kind)
    assert {r.actual: r["count"] for r in found.groupBy("actual").count().collect()} == {k: int(n * 0.25 + 0.5) for k, n in classes.items()}
    assert found.join(rows, "row_id", "left_semi").select("row_id").distinct().count() == found.count()
    assert found.where("actual = predicted").count() / found.count() > 0.7


def test_bounded_neighbours_match_the_search(spark):
    d = table_queries._labelled(table(spark)).na.fill(1.0)
    train, test = d.where("row_id % 3 > 0"), d.where("row_id % 3 = 0")
    every = evaluate.knn_predict(train, test, "row_id", "churn_risk", 3, None, table_queries.CHURN)
    assert spark_rows(evaluate.knn_classify(train, test, "row_id", "churn_risk", table_queries.CHURN, 5_000)) == spark_rows(every)
    assert evaluate.knn_classify(train, test, "row_id", "churn_risk", table_queries.CHURN, 7).count() == test.count()


def test_a_class_unseen_in_training_is_scored(spark):
    train = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(8)], "id long, y string, x double")
    test = spark.createDataFrame([(9, "c", 1.0)], "id long, y string, x double")
    assert [tuple(r) for r in evaluate.fit_predict(train, test, "id", "y", ["x"], "decision_tree").collect()] == [(9, "c", "b")]


def test_profile_has_all_columns_and_violations(spark):
    key, text = ("dataset_id", "load_no"), ("account_id", "plan_code", "site_code")
    found = core_queries.p1_profile(spark, SF)
    assert {r.column_name for r in found.select("column_name").distinct().collect()} == set(table(spark)("churn_rows").columns) - set(key)
    cells = " UNION ALL ".join(
        [f"SELECT dataset_id, load_no, '{c}' AS column_name, CASE WHEN lower(trim({c}, ' \t')) IN {core_queries._TOKENS} THEN NULL ELSE {c} END AS v, '{core_queries.PANEL.patterns[c]}' AS p FROM churn_rows" for c in text]
        + [f"SELECT dataset_id, load_no, '{c}', CAST(epoch_us({c}) AS VARCHAR), '.*' FROM churn_rows" for c in ("observed_at", "ingested_at")])
    want = f"""SELECT dataset_id, load_no, column_name, count(*) AS rows, count(*) - count(v) AS missing, count(DISTINCT v) AS "distinct", count(*) FILTER (NOT regexp_full_match(v, p)) AS violations FROM ({cells}) GROUP BY ALL"""
    some = found.where(F.col("column_name").isin(*text, "observed_at", "ingested_at")).select("dataset_id", "load_no", "column_name", "rows", "missing", "distinct", "violations")
    assert spark_rows(some) == duck_rows(want) and some.agg(F.sum("violations")).first()[0] > 0
    moments = found.where("column_name = 'observed_at'").select("dataset_id", "load_no", *[F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std", "kurtosis")])
    assert spark_rows(moments) == duck_rows("SELECT dataset_id, load_no, round(min(x), 3) AS min, round(max(x), 3) AS max, round(avg(x - 1.7e9) + 1.7e9, 3) AS mean, round(stddev_samp(x - 1.7e9), 3) AS std, round(kurtosis(x - 1.7e9), 3) AS kurtosis FROM (SELECT *, epoch_us(observed_at) / 1e6 AS x FROM churn_rows) GROUP BY ALL")


def test_autoencoder_is_fitted_on_all_rows(spark):
    # The last third of 60,000 rows lies far from the others.
    d = spark.range(0, 60_000, 1, 6).select((F.col("id") % 10 + F.when(F.col("id") < 40_000, 0).otherwise(1000)).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    new = synth.autoencoder(d, ["x", "y"], 2000, epochs=30).toPandas()
    mean = d.agg(F.avg("x")).first()[0]
    assert len(new) == 2000 and abs(new["x"].mean() - mean) < 60 and abs((new["x"] > 500).mean() - 1 / 3) < 0.1
    assert synth.autoencoder(d.limit(0), ["x", "y"], 5, epochs=2).count() == 0


def test_label_draws_know_all_values(spark):
    # 12,000 rare values come before one that holds half of the rows.
    d = spark.range(24_000).select(F.when(F.col("id") < 12_000, F.format_string("a%06d", "id")).otherwise("z").alias("c"))
    new = synth.with_draws(spark.range(4000).withColumnRenamed("id", "row_id"), d, ["c"], 42)
    assert new.count() == 4000 and new.where("c IS NULL").count() == 0 and abs(new.where("c = 'z'").count() / 4000 - 0.5) < 0.04
    assert synth.with_draws(spark.range(3).withColumnRenamed("id", "row_id"), d.limit(0), ["c"], 42).where("c IS NULL").count() == 3
