"""Searches whose queries grow with the rows: the same neighbours as the search of all pairs, in cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import augment, neighbours
from tabweave.operators.neighbours import all_tomek_links, nearest_in_cells, nearest_rows

NAN, INF = float("nan"), float("inf")


def exact(df):
    return sorted(map(tuple, df.select("qid", "rid", "dist", "rank").collect()))


def points(spark, n, places, seed, odd=()):
    """n rows (id, y, v) at so many places; `odd` numbers stand in some dimensions."""
    rng = np.random.default_rng(seed)
    at = np.round(rng.normal(0, 1, (places, 2)), 2)
    v = [[float(x) if rng.random() > 0.1 or not odd else odd[rng.integers(len(odd))] for x in at[rng.integers(places)]] for _ in range(n)]
    ids = rng.permutation(2**60 + np.arange(n))
    return spark.createDataFrame([(int(i), [None, "a", "b"][rng.integers(3)], x) for i, x in zip(ids, v)], "id long, y string, v array<double>")


@pytest.mark.parametrize("group", [None, "y"])
@pytest.mark.parametrize("odd", [(), (None, NAN), (None, INF, -INF, 1e200, -0.0)])
@pytest.mark.parametrize("k", [1, 5])
def test_cells_give_the_search_of_all_pairs(spark, monkeypatch, k, odd, group):
    monkeypatch.setattr(neighbours, "CELL_PLACES", 64)
    for places, share in ((400, 1), (7, 3)):
        rows = points(spark, 900, places, 11 + places, odd).cache()
        asked = rows.where(F.col("id") % share == 0)
        want = nearest_rows(asked, rows, "id", "id", [], [], [], k, group=group, exclude_self=True, vector="v")
        found = exact(nearest_in_cells(rows if share == 1 else asked, rows, "id", "id", "v", k, group))
        assert found and found == exact(want)


def test_few_rows(spark):
    rows = points(spark, 3, 3, 1)
    assert sorted(r["rank"] for r in nearest_in_cells(rows, rows, "id", "id", "v", 5).collect()) == [1, 1, 1, 2, 2, 2]
    for none in (rows.limit(0), rows.limit(1), rows.withColumn("v", F.lit(None).cast("array<double>")), rows.withColumn("v", F.array().cast("array<double>"))):
        assert nearest_in_cells(none, none, "id", "id", "v", 1).count() == 0
        assert all_tomek_links(none, "id", "y", "v").count() == 0


def suppliers(spark, n):
    x = F.round(F.xxhash64("id") % 1_000_000 / 100.0, 2)
    return spark.range(n).select("id", x.alias("bal"), (F.col("id") % 25).alias("nat")).withColumn("side", (F.xxhash64("id", F.lit(1)) % 5 > 1).cast("string"))


def test_smote_tomek_has_no_search_of_all_pairs(spark, monkeypatch):
    def raises(*_, **__):
        raise AssertionError("all rows are compared with all rows")

    monkeypatch.setattr(neighbours, "nearest_rows", raises)
    monkeypatch.setattr(augment, "nearest_rows", raises)
    assert augment.smote_tomek(suppliers(spark, 200), "side", "id", ["bal", "nat"]).count() > 200


@pytest.mark.parametrize("remove", ["both", "majority"])
def test_smote_tomek_of_more_rows_than_a_cell(spark, remove):
    df = suppliers(spark, 9000).cache()
    new = augment.smote(df, "side", "id", ["bal", "nat"]).select((-F.abs(F.xxhash64("key"))).alias("id"), F.col("cls").alias("side"), "bal", "nat")
    whole = df.select("id", "side", "bal", F.col("nat").cast("double")).unionByName(new).toPandas().sort_values("id")
    scale = np.array(augment.column_ranges(df, ["bal", "nat"]))
    x, ids, side = whole[["bal", "nat"]].to_numpy() / scale, whole["id"].to_numpy(), whole["side"].to_numpy()
    assert len(x) > 2 * neighbours.CELL_PLACES
    near = []
    for i in range(len(x)):
        d = np.sqrt((x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2)
        d[i] = np.inf
        near.append(int(d.argmin()))
    near = np.array(near)
    link = (near[near] == np.arange(len(x))) & (side != side[near])
    gone = link if remove == "both" else link & (side == "false")
    assert gone.any()
    found = augment.smote_tomek(df, "side", "id", ["bal", "nat"], remove=remove, majority="false").select("id").toPandas()["id"]
    assert sorted(found) == ids[~gone].tolist()
