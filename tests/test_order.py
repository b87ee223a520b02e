"""Ranks, quantiles and distances of columns that a fixed grid would put into one cell, and of ids that a double cannot hold."""

import numpy as np
from pyspark.sql import functions as F

from tabweave.operators import augment, fidelity, order, relations, synth
from tabweave.plans import physical


def epochs(n, seed=3):
    return np.round(1.7e9 + np.random.default_rng(seed).uniform(0, 1e6, n), 3)


def table(spark, *columns):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns)], ", ".join(f"x{i} double" for i in range(len(columns))))


def test_seconds_since_1970_fill_all_cells(spark):
    x = epochs(20_000)
    cells = order.Cells.of_columns(table(spark, x), ["x0"], 256)
    assert cells.n["n"][0].sum() == len(x) and cells.n["n"][0].max() < 3 * len(x) / 256
    q = order.column_quantiles(table(spark, x), ["x0"], [0.0, 0.25, 0.333, 1.0]).first()
    assert np.allclose([q[f"q{i}"] for i in range(4)], np.quantile(x, [0, 0.25, 0.333, 1.0]), rtol=0, atol=1e-6)


def test_open_cells_on_the_executors(spark, monkeypatch):
    x, y = epochs(5000), epochs(4000, 4) + 2e5
    args = table(spark, x), table(spark, y), ["x0"]
    here = fidelity.ks(*args).first().d, fidelity.wasserstein(*args).first().w1, order.column_quantiles(args[0], ["x0"], [0.1, 0.5]).first()
    grid = np.concatenate([x, y])
    true = max(abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y)))
    assert abs(here[0] - true) < 1e-12
    for module in (order, fidelity):
        monkeypatch.setattr(module, "GATHERED", 0)
    assert (fidelity.ks(*args).first().d, fidelity.wasserstein(*args).first().w1) == here[:2]
    assert order.column_quantiles(args[0], ["x0"], [0.1, 0.5]).first() == here[2]


def test_no_range_of_a_running_sum_is_hot(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit(1).alias("n"))
    physical._SCOPES.append([])
    try:
        t = physical.running_sums(d, ["k"], ["id"], ["n"])
        paths = physical._SCOPES[-1]
        cut = spark.read.parquet(paths[0])
        sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    finally:
        physical._SCOPES.pop()
    assert sum(sizes) == 20_000 and (len(sizes) == 1 or max(sizes) < 12_000)
    assert t.where("n_upto > n_all OR n_upto < 1").count() == 0 and t.groupBy("k").agg(F.count_distinct("n_upto").alias("d"), F.max("n_all").alias("a")).where("d != a").count() == 0


def test_tables_of_a_scope_are_removed(spark):
    from pathlib import Path

    with physical.scope(spark):
        d = physical.materialize(spark.range(3), "gone")
        path = Path(physical._SCOPES[-1][0])
        assert d.count() == 3 and path.exists()
    assert not path.exists()


def test_hashed_ids_lose_no_rows(spark):
    d = spark.range(200).select(F.xxhash64("id").alias("rid"), F.when(F.col("id") < 20, "a").otherwise("b").alias("c"), F.col("id").cast("double").alias("x"))
    assert augment.oversample(d, "c", "rid", ["x"]).count() == 160 and augment.smote(d, "c", "rid", ["x"]).count() == 160
    assert synth.jitter(d, ["x"], 1000, "rid").count() == 1000 and synth.kde(d, ["x"], [], 500, "rid").count() == 500 and synth.interpolate(d, ["x"], 300, "rid").count() == 300


def test_correlation_and_covariance_against_numpy(spark):
    r = np.random.default_rng(8)
    a = 1.7e9 + r.normal(0, 5, 4000)
    b = 0.6 * (a - 1.7e9) + r.normal(0, 3, 4000)
    b[::7] = np.nan
    d = table(spark, a, b, np.full(4000, 0.1))
    got = {(x.a, x.b): x for x in relations.pair_statistics(d, ["x0", "x1", "x2"], diagonal=True).collect()}
    have = ~np.isnan(b)
    assert got["x0", "x1"].n == have.sum() and abs(got["x0", "x1"].r - np.corrcoef(a[have], b[have])[0, 1]) < 1e-9
    assert abs(got["x0", "x0"].cov / np.var(a - 1.7e9, ddof=1) - 1) < 1e-9 and got["x0", "x2"].r == 0.0 and abs(got["x2", "x2"].cov) < 1e-30
    assert [tuple(x) for x in relations.pair_statistics(d.limit(0), ["x0", "x1"]).collect()] == [("x0", "x1", 0, 0.0, 0.0)]


def test_columns_without_values(spark):
    d = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    assert [r.c for r in order.column_quantiles(d, ["x", "y"], [0.5]).collect()] == ["y"]
    assert order.column_quantiles(d.limit(0), ["x", "y"], [0.5]).count() == 0 and fidelity.ks(d, d.limit(0), ["x", "y"]).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        physical.shared_dir(Session())
